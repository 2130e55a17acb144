import random
from collections import defaultdict

import numpy as np

from trailweave.llm.hashing import splitmix
from trailweave.llm.minhash import near_duplicates, sample, weigh, weighted_jaccard

SCHEMA = "doc_id long, text string, digest string, keys int"


def classes(rows):
    groups = defaultdict(set)
    for r in rows:
        groups[r.class_id].add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


def edit(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_planted_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want, at = [], set(), 0
    for size in (1, 1, 2, 3, 40, 1):
        base = [word() for _ in range(200)]
        own = []
        for k in range(size):
            rows.append((at, edit(base, 2 if k else 0, rng), "x", k))
            own.append(at)
            at += 1
        rows.append((at, rows[-1][1], None, None))
        want.add(frozenset([*own, at]))
        at += 1
    for text in ("", None, "one two", "one two", "一二三"):
        rows.append((at, text, None, 1))
        at += 1
    want |= {frozenset([at - 5, at - 4]), frozenset([at - 3, at - 2]), frozenset([at - 1])}
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert classes(got) == want
    assert all(r.class_id <= r.doc_id for r in got)


def test_empty_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = near_duplicates(spark.createDataFrame([(1, "a b c d e f", "", 0)] * 3 + [(None, "x", "", 0), (7, "x", "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in got if r.doc_id == 1) == [(False, 1, 1)] * 3
    assert {r.class_id for r in got if r.doc_id != 1} == {None}


def test_samples_agree_as_often_as_the_similarity():
    weights = np.full(1 << 20, 1.5, np.float32)
    weights[::7] = 1.1
    seeds = splitmix(3, 60)
    rng = random.Random(1)
    agree, real = [], []
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        a, b = weigh(" ".join(words), weights), weigh(edit(words, 4, rng), weights)
        agree.append(np.mean(sample(*a, seeds) == sample(*b, seeds)))
        real.append(weighted_jaccard(a, b))
    assert abs(np.mean(agree) - np.mean(real)) < 0.04


def test_near_pairs_inside_a_template(spark):
    """Texts of a template share buckets without being alike; the pairs among them that are must all be found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(140)]
    rows, want = [], set()
    for i in range(0, 3000, 2):
        own = [word() for _ in range(20)]
        other = own[:12] + [word() for _ in range(8)] if i < 400 else [word() for _ in range(20)]
        rows += [(i, " ".join(template + own), "", 0), (i + 1, " ".join(template + other), "", 0)]
        want |= {frozenset([i, i + 1])} if i < 400 else {frozenset([i]), frozenset([i + 1])}
    assert classes(near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_recall_by_similarity(spark):
    """Every pair of the test documents that is similar by weight is found, and nine of ten or more of each band of plain similarity."""
    from tests.llm.recall import recall

    (bands, weighted), = recall(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spreads=(0.2,)).values()
    assert weighted[0] > 20 and weighted[1] == weighted[0]
    assert all(found >= 0.9 * n for n, found in bands.values())


def test_query_equals_all_pairs(spark, tmp_path):
    """Classes of the query against union-find over every pair of texts, at similarities around the limit."""
    from trailweave.llm.minhash import cell_weights, op3_minhash

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(None, "a b c d e f", "x", 0), (2**62 + 1, "a b c d e f", "x", 0), (2**62 + 3, "", "x", 0), (2**62 + 5, None, "x", 0)]
    for i in range(60):
        base = [word() for _ in range(120)]
        rows += [(3 * i, " ".join(base), "x", 0), (3 * i + 1, edit(base, rng.randrange(1, 6), rng), "x", 0), (3 * i + 2, edit(base, rng.randrange(1, 6), rng), "x", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = cell_weights(docs, len(rows), 0.004, 0.2)
    held = [weigh(r[1], weights) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = held[i], held[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (len(a[0]) and len(b[0]) and weighted_jaccard(a, b) >= 0.8):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = defaultdict(set)
    for i, r in enumerate(rows):
        want[find(i)].add(r[0])
    got = defaultdict(set)
    for r in op3_minhash(spark, str(tmp_path)).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}
