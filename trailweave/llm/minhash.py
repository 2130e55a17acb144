"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Items of a document are its runs of five words. Their document frequencies come
from a count sketch of fixed size over all documents: the share of documents in
a shingle's cell, floored at ``floor``, sets its weight, so the sketch resolves
the same shares at any number of documents and its broadcast has a fixed size.
Each signature component is one consistent weighted sample; ``rows`` of them
make a band. Within a bucket of equal bands every text is compared with the
smallest document and with its neighbour in the order of the components that
follow, which puts similar texts side by side in a different order for each
band. Then one text of each class so far stands for it in the bucket, and the
classes are compared in the same way, until a round links nothing more. What is
left are buckets of several classes; their texts are joined exactly, by a
prefix filter: with items in an order from rare to frequent, the first item
that two texts of the wanted similarity share lies in the leading fifth or so
of both. A template's shingles come last in that order, so texts that share
only a template rarely meet. Links are verified by the weighted Jaccard similarity of
the whole texts. Equal texts share a class before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import mix, shingles, splitmix
from .scratch import Scratch, adopt, table, width

#: Cells of the sketch of document frequencies, in slices that are shuffled on their own.
CELLS, SLICES = 1 << 20, 64
#: Hash bits that pick a quantile of a random variate.
BITS = 12


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middle of 2**BITS equal shares, by bisection of 1 - (1 + x) exp(-x)."""
    share = (np.arange(1 << BITS) + 0.5) / (1 << BITS)
    low, high = np.zeros_like(share), np.full_like(share, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < share
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_gamma_quantiles()).astype(np.float32)
_UNIFORM = ((np.arange(1 << BITS) + 0.5) / (1 << BITS)).astype(np.float32)


def weigh(text: str | None, weights: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights: term frequency times the weight of their cell."""
    items, tf = np.unique(shingles(text or "", size), return_counts=True)
    return items, tf.astype(np.float32) * weights[(items >> np.uint64(64 - 20)).astype(np.int64)]


def sample(items: np.ndarray, weight: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One consistent weighted sample for each seed, as a hash of the chosen item and its level."""
    mask = np.uint64((1 << BITS) - 1)
    log_w = np.log(weight)
    m = len(seeds)
    rows = np.arange(m)
    best, chosen, level = np.full(m, np.inf, np.float32), np.zeros(m, np.uint64), np.zeros(m, np.int64)
    step = max(1, 20000 // m)  # items at once: all seeds of a stretch stay in the cache
    for a in range(0, len(items), step):
        some = items[a : a + step]
        h = (some ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        r = _GAMMA[(h >> np.uint64(52)).view(np.int64)]
        log_c = _LOG_GAMMA[(h >> np.uint64(40) & mask).view(np.int64)]
        beta = _UNIFORM[(h >> np.uint64(28) & mask).view(np.int64)]
        t = np.floor(log_w[a : a + step] / r + beta)
        cost = log_c - r * (t - beta + 1)
        at = cost.argmin(axis=1)
        least = cost[rows, at]
        better = least < best
        best[better] = least[better]
        chosen[better] = some[at[better]]
        level[better] = t[rows, at][better].astype(np.int64)
    return mix(mix(chosen ^ seeds) + (level.view(np.uint64) & np.uint64(0xFFFFFFFF)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; two texts without items are equal."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return both / (total - both)


def cell_counts(docs: DataFrame) -> DataFrame:
    """Documents with a shingle in each cell of the sketch: (slice, counts as packed 32-bit integers). Tasks count on their own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(CELLS, np.int32)
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                cells = [np.unique(shingles(t or "") >> np.uint64(44)) for t in pdf["text"][a : a + 200]]
                counts += np.bincount(np.concatenate(cells).astype(np.int64), minlength=CELLS).astype(np.int32)
        if counts.any():
            yield pd.DataFrame({"slice": np.arange(SLICES, dtype=np.int32), "counts": [x.tobytes() for x in counts.reshape(SLICES, -1)]})

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS // SLICES, np.int64)
        for pdf in batches:
            for x in pdf["counts"]:
                total += np.frombuffer(x, np.int32)
        yield pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    return docs.select("text").mapInPandas(run, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary")


def gathered(slices: DataFrame) -> np.ndarray:
    """The whole sketch on the driver."""
    counts = np.zeros(CELLS, np.float64)
    for r in slices.collect():
        counts.reshape(SLICES, -1)[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return counts


def cell_weights(docs: DataFrame, n: int, floor: float, spread: float) -> np.ndarray:
    """Weight of each cell: 1 for a shingle of all documents up to 1 + spread for one in a share of ``floor`` or less."""
    share = np.clip(gathered(cell_counts(docs)) / max(n, 1), floor, 1.0)
    return (1 + spread * np.log(share) / np.log(floor)).astype(np.float32)


def prefix(items: np.ndarray, weight: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading items, rare cells first, the weight from each on, and the whole weight. Of two texts with the similarity ``threshold`` the first shared item leads in both, as all that they share lies from it on."""
    order = np.lexsort((items, counts[(items >> np.uint64(64 - 20)).astype(np.int64)]))
    rest = np.cumsum(weight[order][::-1].astype(np.float64))[::-1]
    lead = rest >= threshold * rest[0] * (1 - 1e-6)
    return items[order][lead], rest[lead], float(rest[0])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 14, rows: int = 3, floor: float = 0.004, spread: float = 0.2, keep_first: bool = False) -> DataFrame:
    """Class of near-duplicates of each row: doc_id, class_id (smallest doc_id of the class), class_links (verified links of the row's text).

    Null and empty texts, and others without a word, are classes of equal texts.
    Texts under five words are one shingle each. Rows that repeat a doc_id are
    told apart by their texts; rows equal in both, too, each get a row. A null
    doc_id stays null in doc_id and counts as the smallest number. An empty
    table gives an empty result. Other columns are ignored. With ``keep_first``
    the result is instead the rows of ``docs``, with all columns, that stand for
    their classes: one each, with the smallest doc_id, then the smallest digest.
    """
    docs = adopt(docs)
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = base.count()
    weights = spark.sparkContext.broadcast(cell_weights(base, n, floor, spread))
    seeds = splitmix(909, bands * rows)

    @F.pandas_udf("array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            keys = []
            for text in texts:
                items, weight = weigh(text, weights.value)
                if not len(items):
                    keys.append(None)
                    continue
                s = sample(items, weight, seeds).reshape(bands, rows)
                k = s[:, 0]
                for c in range(1, rows):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + s[:, c])
                keys.append(k.view(np.int64))
            yield pd.Series(keys, dtype=object)

    signed = scratch.keep(base.select("doc_id", F.unhex(F.md5("text")).alias("digest"), sign("text").alias("keys")))
    smallest = F.lit(-(1 << 63))
    texts = scratch.keep(signed.groupBy("digest").agg(F.min(F.coalesce("doc_id", smallest)).alias("id"), F.first("keys").alias("keys")))
    buckets = texts.where("keys is not null").select("id", "digest", "keys", F.posexplode("keys").alias("band", "key"))
    turned = [F.element_at("keys", (F.col("band") + i) % bands + 1) for i in (1, 2, 3)]
    buckets = scratch.keep(buckets.select(F.xxhash64("band", "key").alias("key"), *[t.alias(f"s{i}") for i, t in enumerate(turned)], "id", "digest"))
    firsts = scratch.keep(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "digest")).alias("first")).where("n > 1").select("key", F.col("first.digest").alias("first")))
    shared = scratch.keep(buckets.join(firsts, "key"))
    wanted = scratch.keep(shared.select("id", "digest").distinct())
    chosen = base.select(F.coalesce("doc_id", smallest).alias("id"), F.unhex(F.md5("text")).alias("digest"), "text")
    # Merged at every size: texts move once, also where the wanted list would fit into a broadcast.
    held = scratch.keep(chosen.join(wanted.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"]).select("digest", "text"))
    scratch.drop(buckets, firsts, wanted)
    ground = [signed, texts, shared, held]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, None
        for pdf in batches:
            good = []
            for d, a, b in zip(pdf["da"], pdf["ta"], pdf["tb"], strict=True):
                if d != last:
                    last, known = d, weigh(a, weights.value)
                good.append(weighted_jaccard(known, weigh(b, weights.value)) >= threshold)
            yield pdf[["da", "db"]].assign(good=good)

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, before = None, None, None
        for pdf in batches:
            da, db = [], []
            for k, c, d in zip(pdf["key"].tolist(), pdf["class"], pdf["digest"], strict=True):
                if k == key and c != own:
                    da.append(min(d, before))
                    db.append(max(d, before))
                key, own, before = k, c, d
            yield pd.DataFrame({"da": da, "db": db})

    def told(pairs: DataFrame) -> DataFrame:
        """Verdicts (da, db, good) on pairs of texts; the hot side of a pair is read in order, so its shingles are made once."""
        left, right = held.withColumnsRenamed({"digest": "da", "text": "ta"}), held.withColumnsRenamed({"digest": "db", "text": "tb"})
        half = scratch.keep(pairs.join(right, "db"))
        out = scratch.keep(half.join(left, "da").mapInPandas(verify, "da binary, db binary, good boolean"))
        told_so_far.append(out)
        scratch.only(*ground, *told_so_far)
        return out

    def in_order(rows: DataFrame) -> DataFrame:
        """Pairs of neighbours of different classes in each bucket, sorted by the components that follow the bucket's own."""
        order = ["key", "s0", "s1", "s2", "digest"]
        return rows.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).select("key", "class", "digest").mapInPandas(neighbours, "da binary, db binary")

    def missed(open_texts: DataFrame) -> DataFrame:
        """Pairs (da, db) of texts of different classes that can reach the threshold: they share a leading item from which on both hold enough weight."""
        counts = spark.sparkContext.broadcast(gathered(cell_counts(open_texts)).astype(np.int32))

        def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 100):
                    some = pdf[a : a + 100]
                    found = [prefix(*weigh(t, weights.value), counts.value, threshold) for t in some["text"]]
                    n = [len(f[0]) for f in found]
                    rows = some[["digest", "class"]].loc[some.index.repeat(n)].reset_index(drop=True)
                    yield rows.assign(item=np.concatenate([f[0] for f in found]).view(np.int64), rest=np.concatenate([f[1] for f in found]), size=np.repeat([f[2] for f in found], n))

        leads = scratch.keep(open_texts.mapInPandas(lead, "digest binary, class long, item long, rest double, size double"))
        # Most leading items belong to one class only and go before the join.
        several = leads.groupBy("item").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("item")
        leads = scratch.keep(leads.join(several, "item"))
        a, b = leads.select("item", *[F.col(c).alias(f"{c}_a") for c in ("digest", "class", "rest", "size")]), leads.select("item", *[F.col(c).alias(f"{c}_b") for c in ("digest", "class", "rest", "size")])
        reach = F.least("rest_a", "rest_b") >= threshold / (1 + threshold) * (1 - 1e-6) * (F.col("size_a") + F.col("size_b"))
        met = a.join(b, "item").where((F.col("digest_a") < F.col("digest_b")) & (F.col("class_a") != F.col("class_b")) & reach)
        return met.select(F.col("digest_a").alias("da"), F.col("digest_b").alias("db")).distinct()

    told_so_far: list[DataFrame] = []
    star = shared.where("first <> digest").select(F.least("first", "digest").alias("da"), F.greatest("first", "digest").alias("db"))
    seen = told(scratch.keep(star.union(in_order(shared.withColumn("class", F.col("digest")))).distinct()))
    while True:
        links = seen.where("good").select("da", "db")
        classes = connected_components(links.toDF("a", "b")).toDF("digest", "class")
        # One text of each class stands for it in a bucket; buckets of several classes are gone through again.
        named = shared.join(classes, "digest", "left").withColumn("class", F.coalesce("class", "digest"))
        one = named.groupBy("key", "class").agg(F.min(F.struct("s0", "s1", "s2", "digest")).alias("one")).select("key", "class", "one.*")
        fresh = scratch.keep(in_order(one).distinct().join(seen.select("da", "db"), ["da", "db"], "left_anti"))
        if fresh.isEmpty():
            break
        more = told(fresh)
        if more.where("good").isEmpty():
            break
        seen = seen.union(more)
    # Buckets of three texts or more that still hold several classes may hold pairs that never met: these are joined exactly.
    named = scratch.keep(named.select("key", "digest", "class"))
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).where("n > 2 and a <> b").select("key")
    unsettled = scratch.keep(named.join(mixed, "key").groupBy("digest").agg(F.xxhash64(F.first("class")).alias("class")))
    if not unsettled.isEmpty():
        rest = scratch.keep(missed(held.join(unsettled.hint("merge"), "digest")).join(seen.select("da", "db"), ["da", "db"], "left_anti"))
        if not rest.isEmpty():
            seen = seen.union(told(rest))
            classes = connected_components(seen.where("good").select("da", "db").toDF("a", "b")).toDF("digest", "class")
    scratch.only(*ground, *told_so_far)
    ids = texts.select("digest", "id")
    roots = classes.join(ids, "digest").groupBy("class").agg(F.min(F.struct("id", "digest")).alias("root"))
    roots = scratch.keep(roots.select("class", F.col("root.id").alias("class_id"), F.col("root.digest").alias("root")))
    classes = scratch.keep(classes.join(roots, "class").drop("class"))
    if keep_first:
        stand = scratch.keep(ids.join(classes.where("root <> digest"), "digest", "left_anti").select("id", "digest"))
        scratch.only(stand)
        columns = [F.col(f"`{c}`") for c in docs.columns]
        marked = docs.select(F.coalesce(F.col("doc_id").cast("long"), smallest).alias("id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("digest"), F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("h"))
        # Of rows equal in id and text the one with the least hash of its columns stands; among rows equal in all columns any one.
        return marked.join(stand.hint("merge"), ["id", "digest"]).groupBy("id", "digest").agg(F.min_by("row", "h").alias("row")).select("row.*")
    degree = seen.where("good").select(F.explode(F.array("da", "db")).alias("digest")).groupBy("digest").agg(F.count("*").alias("class_links"))
    of_text = ids.join(classes.select("digest", "class_id"), "digest", "left").join(degree, "digest", "left")
    of_text = scratch.keep(of_text.select("digest", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links")))
    return signed.select("doc_id", "digest").join(of_text, "digest").select("doc_id", F.when(F.col("class_id") != smallest, F.col("class_id")).alias("class_id"), "class_links", F.hex("digest").alias("text_md5"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
