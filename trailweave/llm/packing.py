"""Best-fit packing of token sequences, planned on a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the count of each
length reaches the driver: capacity numbers at most. The plan takes lengths from
long to short and gives each run of equal pieces the tightest open space, whole
runs of equal bins at a time. Pieces then take their planned slots by their rank
within their length. Ranks come from counts for each length and bucket of
documents, so that no task gathers all pieces of a frequent length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, adopt, table, width
from .tokenize import default_path, tokenizer_at

END = np.array([1], "<u4").tobytes()



def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): pieces of that length with ranks from the first take consecutive sequences, all at that offset.

    Best fit over counts: bins with equal free space form runs of consecutive
    sequences; a length takes runs of the smallest space that still holds it,
    then opens new sequences, several pieces to each. The size of the plan
    depends on the capacity only.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # space -> runs (first sequence, how many)
    spaces: list[int] = []
    sequences = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, n: int, space: int, length: int = length) -> None:
            """As many pieces as fit into each of n bins, then the rest into one bin."""
            nonlocal left, rank
            deep = space // length
            full = min(n, left // deep)
            for k in range(deep if full else 0):
                rows.append((length, rank, full, first, capacity - space + k * length))
                rank += full
            left -= full * deep
            put(space - deep * length, first, full)
            if left and full < n:
                for k in range(left):
                    rows.append((length, rank, 1, first + full, capacity - space + k * length))
                    rank += 1
                put(space - left * length, first + full, 1)
                full, left = full + 1, 0
            put(space, first + full, n - full)

        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                deep = capacity // length
                n = -(-left // deep)
                sequences += n
                place(sequences - n, n, capacity)
                continue
            space = spaces[i]
            run = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(i)
            place(*run, space)
    return np.array(rows, np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Pieces of the token ids of every text, each text ended by id 1. Only texts go through Python, so ids of documents stay what they are."""

    @F.pandas_udf("struct<n:long,sums:array<long>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_at(path)
        for texts in batches:
            sizes, sums = [], []
            for ids in tokenizer.encode_all(texts):
                ids += END
                sizes.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[s : s + 4 * capacity]) for s in range(0, len(ids), 4 * capacity)])
            yield pd.DataFrame({"n": sizes, "sums": pd.Series(sums, dtype=object)})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), cut.asNondeterministic()(F.col("text").cast("string")).alias("p"))
    start = F.col("piece").cast("long") * capacity
    each = found.select("doc_id", "p.n", F.posexplode("p.sums").alias("piece", "ids_crc32"))
    return each.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("length"), "ids_crc32")


def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """Slots of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end token alone. Texts over the capacity are cut
    into pieces of that size, the last as short as it comes; no other text is
    cut. Rows with equal or null doc_id are separate documents. Equal lengths
    rank by doc_id, piece and checksum, so ties are settled the same way each
    time but for the order of rows equal in all three. An empty table gives an
    empty result. Other columns are ignored.
    """
    docs = adopt(docs)
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    buckets = max(64, width(spark))
    pieces = scratch.keep(cut_pieces(docs, path or default_path(), capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = scratch.keep(counts)
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("before", F.lit(0)).cast("long").alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(order)).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    by = np.lexsort((slots[:, 1], slots[:, 0]))
    planned = spark.sparkContext.broadcast(slots[by])

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def take(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        own, span = planned.value, 1 << 44
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = own[np.searchsorted(own[:, 0] * span + own[:, 1], n * span + r, side="right") - 1]
        return pd.DataFrame({"sequence_id": s[:, 3] + r - s[:, 1], "offset": s[:, 4]})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*columns, take.asNondeterministic()("length", "rank").alias("slot"))
    return placed.select(*columns, "slot.sequence_id", "slot.offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
