"""How many similar pairs share a class: ``python -m tests.llm.recall /root/testdata/sf0.1``.

All pairs of different texts with a plain 5-word Jaccard similarity of at least
``low`` come from an exact join on leading shingles, rare ones first; nothing of
the operator is used but its hashes of shingles and, for the weighted
similarity, its weights.
"""

import hashlib
import math
import sys
from collections import Counter, defaultdict

from trailweave.llm.hashing import shingles
from trailweave.llm.minhash import cell_weights, near_duplicates, weigh, weighted_jaccard

BANDS = (0.8, 0.82, 0.85, 0.9, 0.95, 1.01)


def similar_pairs(texts, low):
    """(i, j, similarity) of every pair of sets of shingles with a similarity of at least ``low``."""
    sets = [set(shingles(t).tolist()) for t in texts]
    df = Counter(x for s in sets for x in s)
    held = defaultdict(list)
    out = []
    for i, s in enumerate(sets):
        if not s:
            continue
        lead = sorted(s, key=lambda x: (df[x], x))[: len(s) - math.ceil(low * len(s)) + 1]
        met = {j for x in lead for j in held[x]}
        for j in met:
            if min(len(s), len(sets[j])) >= low * max(len(s), len(sets[j])):
                both = len(s & sets[j])
                if both / (len(s) + len(sets[j]) - both) >= low:
                    out.append((j, i, both / (len(s) + len(sets[j]) - both)))
        for x in lead:
            held[x].append(i)
    return out


def recall(docs, spreads=(0.2, 10.0), low=0.66):
    """For each spread: {band of plain similarity: (pairs, found)}, and (pairs, found) with a weighted similarity of 0.8 or more."""
    rows = {}
    for r in docs.where("doc_id is not null").select("doc_id", "text").collect():
        rows.setdefault(hashlib.md5((r.text or "").encode()).digest(), (r.doc_id, r.text or ""))
    ids, texts = zip(*rows.values())
    pairs = similar_pairs(texts, low)
    n = docs.count()
    out = {}
    for spread in spreads:
        of = {r.doc_id: r.class_id for r in near_duplicates(docs, spread=spread).collect()}
        weights = cell_weights(docs, n, 0.004, spread)
        bands, weighted = {b: [0, 0] for b in BANDS[:-1]}, [0, 0]
        known = {}
        for i, j, s in pairs:
            found = of[ids[i]] == of[ids[j]]
            if s >= 0.8:
                b = max(x for x in BANDS[:-1] if x <= s)
                bands[b][0] += 1
                bands[b][1] += found
            a, b = (known.setdefault(k, weigh(texts[k], weights)) for k in (i, j))
            if weighted_jaccard(a, b) >= 0.8:
                weighted[0] += 1
                weighted[1] += found
        out[spread] = {k: tuple(v) for k, v in bands.items()}, tuple(weighted)
    return out


def main():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for spread, (bands, weighted) in recall(spark.read.parquet(f"{sys.argv[1]}/documents.parquet")).items():
        print(f"spread {spread}: plain similarity", {k: f"{found} of {n}" for k, (n, found) in bands.items()}, "weighted at least 0.8:", f"{weighted[1]} of {weighted[0]}")


if __name__ == "__main__":
    main()
