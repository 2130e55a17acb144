"""Exact top-k search by a vector-approximation file.

Vectors become integers floor(scale * x). Two files are written once, in blocks
of the same vectors: the approximation holds, for each component, the number of
its cell in one byte, and the exact vectors lie in the other. The scan reads
only cells: a block of queries meets a block of cells by an equi-join on the
block's number, one product with the cells bounds each inner product from below
and above, and what can't be among the k best of its block is left at once. The kth best lower
bound over all blocks then settles which vectors a query needs: their exact
values are fetched by row number and read best bound first, until no bound left
can reach the kth score; ties at the kth score are read as well, since the
smaller id wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, adopt, table, width

#: Vectors of a block of candidates and of a block of queries; the bounds of a pair of blocks take some 8 MB.
GROUP, QUERIES = 1 << 12, 128
#: Exact integers in doubles, and what sums of products in them may be off by.
SAFE, SLACK = 2.0**52, 2.0**-30
MOST = (1 << 63) - 1


def integers(v: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, whatever its size."""
    return [math.floor(scale * x) if abs(x) < SAFE else scale * int(x) for x in v.tolist()]


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles: exact where it is below SAFE, infinite beyond doubles."""
    with np.errstate(over="ignore"):
        return np.floor(v * scale)


def product(a: np.ndarray, b: np.ndarray, scale: int) -> int:
    """Exact inner product of the integers of two vectors."""
    x, y = scaled(a, scale), scaled(b, scale)
    with np.errstate(over="ignore", invalid="ignore"):
        if float(np.abs(x) @ np.abs(y)) < SAFE:
            return int(x @ y)
    return sum(p * q for p, q in zip(integers(a, scale), integers(b, scale), strict=True))


def useful(ids: np.ndarray, mat: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best of any query: of equal vectors those of the k + 1 smallest ids, and of rows equal in id too at most k. The others lose every tie to k of these, also if one id is the query's own."""
    alike = np.unique(mat, axis=0, return_inverse=True)[1].reshape(-1) if mat.shape[1] else np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, alike))
    a, i = alike[order], ids[order]
    at = np.arange(len(ids))
    new_vector = np.concatenate([[True], a[1:] != a[:-1]])[: len(ids)]
    new_id = new_vector | np.concatenate([[True], i[1:] != i[:-1]])[: len(ids)]
    nth_id = np.cumsum(new_id) - np.cumsum(new_id)[np.maximum.accumulate(np.where(new_vector, at, 0))]
    copy = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.sort(order[(nth_id <= k) & (copy < k)])


def cells(mat: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each component as a byte, lower corner of the first cell, size of a cell, what is left within a cell) by dimension, so that low + step * cell <= x <= low + step * cell + rest."""
    low, high = mat.min(axis=0), mat.max(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        step = np.maximum(1.0, np.ceil((high - low + 1) / levels))
        cell = np.clip(np.floor((mat - low) / step), 0, levels - 1)
        rest = np.maximum((mat - low - cell * step).max(axis=0), 0)
        down = np.minimum((mat - low - cell * step).min(axis=0), 0)
    cell = np.where(np.isfinite(cell), cell, 0)
    return cell.astype(np.uint8), low + down, step, rest - down


def bounds(queries: np.ndarray, cell: np.ndarray, low: np.ndarray, step: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner product of each query with each vector of a block."""
    with np.errstate(over="ignore", invalid="ignore"):
        at = (queries @ low)[:, None] + (queries * step) @ cell.T
        size = np.abs(queries) @ (np.abs(low) + step * 256 + rest)
        under, over = np.minimum(queries, 0) @ rest - size * SLACK, np.maximum(queries, 0) @ rest + size * SLACK
        lower, upper = at + under[:, None], at + over[:, None]
    return np.where(np.isfinite(lower), lower, -np.inf), np.where(np.isfinite(upper), upper, np.inf)


def survivors(query_ids: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of the pairs that may be among the k best of the block; a query never meets its own id."""
    other = ids[None, :] != query_ids[:, None]
    lower = np.where(other, lower, -np.inf)
    enough = other.sum(axis=1) >= k
    if lower.shape[1] >= k:
        kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
    else:
        kth = np.full(len(lower), -np.inf)
    sure = np.where(enough, kth, -np.inf)
    return np.nonzero(other & (upper >= sure[:, None]))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, levels: int = 256, group: int = GROUP) -> DataFrame:
    """The k highest integer inner products of each query among all other vectors.

    Queries are the rows whose id is divisible by ``every``. A vector that is
    null, or holds a null or a non-finite component, takes no part, nor does a
    row without id; finite components of any size do, and products are exact
    integers of any size. A score beyond 64 bits is returned as the nearest
    64-bit value, after ranks are settled. Only vectors of equal length are
    compared; an empty vector scores 0 with every other empty one. Rows that
    repeat an id are searched one by one and a query never meets a row of its
    own id; equal ids with equal scores keep their rows. Fewer than k partners
    give fewer rows, an empty table none. Other columns are ignored.
    Returns query_id, rank, vec_id, score.
    """
    vectors = adopt(vectors)
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))

    def blocks(size: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}
            made = 0

            def block(dim: int, rows: list) -> pd.DataFrame:
                nonlocal made
                made += 1
                part = pd.concat(rows)
                return pd.DataFrame({"local": [made - 1], "dim": [dim], "ids": [part["id"].to_numpy(np.int64).tobytes()], "mat": [np.concatenate(part["v"].to_list()).astype(np.float64).tobytes()]})

            for pdf in batches:
                for dim, part in pdf.groupby(pdf["v"].map(len)):
                    for a in range(0, len(part), size):
                        rows = held.setdefault(dim, [])
                        rows.append(part.iloc[a : a + size])
                        if sum(map(len, rows)) >= size:
                            yield block(dim, held.pop(dim))
            for dim, rows in held.items():
                yield block(dim, rows)

        return run

    made = scratch.keep(base.mapInPandas(blocks(group), "local int, dim int, ids binary, mat binary").withColumn("part", F.spark_partition_id()))
    # Blocks are numbered without gaps, from the number of blocks of each partition.
    offsets, slots = [], 0
    for r in made.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(slots)]
        slots += r["n"]
    if not slots:
        return spark.createDataFrame([], schema)
    made = made.withColumn("slot", F.create_map(*offsets)[F.col("part")] + F.col("local"))

    def exact_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for slot, dim, ids, mat in zip(pdf["slot"].tolist(), pdf["dim"].tolist(), pdf["ids"], pdf["mat"], strict=True):
                n = len(ids) // 8
                rows = useful(np.frombuffer(ids, np.int64), np.frombuffer(mat).reshape(n, dim), k)
                yield pd.DataFrame({"slot": np.full(len(rows), slot), "row": rows.astype(np.int32), "vector": [mat[8 * dim * r : 8 * dim * (r + 1)] for r in rows.tolist()]})

    def approximate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for slot, dim, ids, mat in zip(pdf["slot"].tolist(), pdf["dim"].tolist(), pdf["ids"], pdf["mat"], strict=True):
                own = np.frombuffer(ids, np.int64)
                values = np.frombuffer(mat).reshape(len(own), dim)
                rows = useful(own, values, k)
                cell, low, step, rest = cells(scaled(values[rows], scale), levels)
                yield pd.DataFrame({"slot": [slot], "dim": [dim], "ids": [own[rows].tobytes()], "rows": [rows.astype(np.int32).tobytes()], "cells": [cell.tobytes()], "corners": [np.stack([low, step, rest]).tobytes()]})

    exact = scratch.keep(made.select("slot", "dim", "ids", "mat").mapInPandas(exact_rows, "slot int, row int, vector binary"))
    files = scratch.keep(made.select("slot", "dim", "ids", "mat").mapInPandas(approximate, "slot int, dim int, ids binary, rows binary, cells binary, corners binary"))
    asked = scratch.keep(base.where(F.pmod("id", F.lit(every)) == 0).mapInPandas(blocks(QUERIES), "local int, dim int, ids binary, mat binary").select(F.monotonically_increasing_id().alias("qslot"), "dim", F.col("ids").alias("qids"), F.col("mat").alias("qmat")))
    visits = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # Queries grow with the table: never a broadcast, whatever the size of their files says. Blocks are few and dear, so their tasks are not coalesced.
    tasks = min(slots, 4 * width(spark))
    pairs = visits.repartition(tasks, "slot").hint("merge").join(files.repartition(tasks, "slot"), ["slot", "dim"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, cell = None, None
        for pdf in batches:
            for slot, dim, qslot, qids, qmat, ids, rows, raw, corners in zip(*[pdf[c] for c in ("slot", "dim", "qslot", "qids", "qmat", "ids", "rows", "cells", "corners")], strict=True):
                qi, ci = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                if slot != last:
                    last, cell = slot, np.frombuffer(raw, np.uint8).reshape(len(ci), dim).astype(np.float64)
                lower, upper = bounds(scaled(np.frombuffer(qmat).reshape(len(qi), dim), scale), cell, *np.frombuffer(corners).reshape(3, dim))
                i, j = survivors(qi, ci, lower, upper, k)
                yield pd.DataFrame({"qslot": np.full(len(i), qslot), "qrow": i.astype(np.int32), "query_id": qi[i], "slot": np.full(len(i), slot, np.int32), "row": np.frombuffer(rows, np.int32)[j], "vec_id": ci[j], "lower": lower[i, j], "upper": upper[i, j]})

    met = pairs.mapInPandas(scan, "qslot long, qrow int, query_id long, slot int, row int, vec_id long, lower double, upper double")
    falling = Window.partitionBy("qslot", "qrow").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = scratch.keep(met.withColumn("kth", F.nth_value("lower", k).over(falling)).where("kth is null or upper >= kth").drop("lower", "kth"))

    def query_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qslot, dim, qids, qmat in zip(pdf["qslot"].tolist(), pdf["dim"].tolist(), pdf["qids"], pdf["qmat"], strict=True):
                n = len(qids) // 8
                yield pd.DataFrame({"qslot": np.full(n, qslot), "qrow": np.arange(n, dtype=np.int32), "query": [qmat[8 * dim * r : 8 * dim * (r + 1)] for r in range(n)]})

    queries = asked.mapInPandas(query_rows, "qslot long, qrow int, query binary")
    read = open_.hint("merge").join(exact, ["slot", "row"]).drop("slot", "row").hint("merge").join(queries, ["qslot", "qrow"])
    # The window also keeps all rows of a query in one task, in the order of reading.
    read = read.withColumn("nth", F.row_number().over(Window.partitionBy("qslot", "qrow").orderBy(F.desc("upper"), "vec_id")))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["qslot", "qrow", "query_id", "query", "upper", "vec_id", "vector", "nth"]
        rows = (r for pdf in batches for r in zip(*[pdf[c] for c in names], strict=True))
        done: list[tuple] = []
        for _, own in groupby(rows, key=lambda r: r[:2]):
            best: list[tuple[int, int]] = []
            for _, _, query_id, query, upper, vec_id, vector, nth in own:
                if nth > k and upper < -best[-1][0]:
                    break
                best.append((-product(np.frombuffer(query), np.frombuffer(vector), scale), vec_id))
                best.sort()
                del best[k:]
            done += [(query_id, n, i, max(-MOST - 1, min(MOST, -s))) for n, (s, i) in enumerate(best, 1)]
            if len(done) > 5000:
                yield pd.DataFrame(done, columns=["query_id", "rank", "vec_id", "score"])
                done = []
        yield pd.DataFrame(done, columns=["query_id", "rank", "vec_id", "score"])

    return read.mapInPandas(settle, schema)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
