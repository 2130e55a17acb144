"""Region sequences: cutting, frequent patterns and their support."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import SequenceParams


def cut_sequences(visits: DataFrame, track: Sequence[str], piece: str, run: str, region: str, gap: str, min_length: int = 2) -> DataFrame:
    """Sequences of regions between cuts: track, piece, segment_index, regions (array), length. A piece or a gap begins a new segment; numbers restart in each piece and count short segments too."""
    w = Window.partitionBy(*track, piece).orderBy(run)
    cut = F.when(F.row_number().over(w) == 1, 0).otherwise(F.col(gap).cast("int"))
    seg = visits.withColumn("segment_index", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = seg.groupBy(*track, piece, "segment_index").agg(F.transform(F.sort_array(F.collect_list(F.struct(run, region))), lambda s: s[region]).alias("regions"))
    return out.withColumn("length", F.size("regions")).where(F.col("length") >= min_length)


def support_threshold(sequences: int, p: SequenceParams) -> int | None:
    """Least support of a pattern: a share of the sequences, rounded half up, but not under the floor."""
    return None if sequences <= 0 else max(math.floor(p.support_ratio * sequences + 0.5), p.support_floor)


def contiguous_patterns(sequences: DataFrame, keep: Sequence[str], max_length: int = 10, column: str = "regions") -> DataFrame:
    """Every distinct run of 2 to ``max_length`` regions of each sequence, once for each sequence."""
    size = F.size(column)
    starts = F.sequence(F.lit(1), size - 1)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(max_length), size - i + 1)), lambda n: F.slice(F.col(column), i, n))))
    return sequences.where(size >= 2).select(*keep, F.explode(F.array_distinct(runs)).alias("pattern"))


def contains(sequence: Column, pattern: Column) -> Column:
    """Whether the pattern occurs in order, gaps allowed: each sequence element advances the match by at most one."""
    n = F.aggregate(sequence, F.lit(0), lambda k, r: F.when((k < F.size(pattern)) & (F.try_element_at(pattern, k + 1) == r), k + 1).otherwise(k))
    return n == F.size(pattern)


def first_at_or_after(positions: Column, start: Column) -> Column:
    """Least of the sorted positions that is not before the start; null if none."""
    return F.try_element_at(F.filter(positions, lambda p: p >= start), F.lit(1))


def contained_support(sequences: DataFrame, patterns: DataFrame, column: str = "regions", by: Sequence[str] = ()) -> DataFrame:
    """Sequences that contain each pattern, with gaps (support) and as a run (contiguous), for each value of ``by``. Equal sequences are counted before they meet patterns, and a pattern only meets those that hold its rarest region, by an equi-join, before the exact test."""
    weighed = sequences.groupBy(column, *by).agg(F.count("*").alias("__n"))
    held = weighed.select("*", F.explode(F.array_distinct(column)).alias("__r"))
    freq = held.groupBy("__r").agg(F.count("*").alias("__f"))
    keys = patterns.select("pattern").distinct().select("pattern", F.explode(F.array_distinct("pattern")).alias("__r")).join(freq, "__r", "left")
    keys = keys.groupBy("pattern").agg(F.min_by("__r", F.struct(F.coalesce("__f", F.lit(0)), "__r")).alias("__r"))
    met = keys.join(held, "__r").where(contains(F.col(column), F.col("pattern")))
    run = F.when(is_run(F.col(column), F.col("pattern")), F.col("__n")).otherwise(0)
    return met.groupBy("pattern", *by).agg(F.sum("__n").alias("support"), F.sum(run).alias("contiguous"))


def is_run(sequence: Column, pattern: Column) -> Column:
    """Whether the pattern occurs without gaps."""
    last = F.size(sequence) - F.size(pattern) + 1
    return F.when(last >= 1, F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(sequence, i, F.size(pattern)) == pattern)).otherwise(False)


def scopes_of(days: Sequence[str], clear: Sequence[str], merged: str = "clear-days") -> list[tuple[str, str]]:
    """(scope, day): one scope for each day, and the merged one of all clear days only if every one of them is there."""
    out = [(d, d) for d in days]
    return out + [(merged, d) for d in clear] if clear and set(clear) <= set(days) else out


def unknown_regions(patterns: DataFrame, regions: DataFrame, region: str = "region") -> list:
    """Regions that patterns name and the partition doesn't hold, in order; at most 100 are listed."""
    named = patterns.select(F.explode("pattern").alias("r")).distinct()
    return [x["r"] for x in named.join(regions.select(F.col(region).alias("r")), "r", "left_anti").orderBy("r").limit(100).collect()]


def attribute_patterns(sequences: DataFrame, patterns: DataFrame, scopes: DataFrame, adjacency: DataFrame, codes: DataFrame, day: str = "day", hour: str = "start_hour", hours: Sequence[int] = (6, 7, 8, 9)) -> DataFrame:
    """Mined patterns (scope, pattern, support) with what the sequences of their scope say.

    Adds contained (sequences that hold it, gaps allowed), contiguous (as a run),
    hour_<h> (contained, by hour of the start), all_steps_adjacent (each step goes
    between regions that share an edge), codes and districts in order. ``scopes``
    has (scope, day), ``adjacency`` pairs a < b, ``codes`` (region, code, district).
    A region that ``codes`` doesn't hold is an error that names it.
    """
    if missing := unknown_regions(patterns, codes):
        raise ValueError(f"patterns name regions that the partition does not hold: {missing}")
    counted = contained_support(sequences, patterns, by=[day, hour])
    one = counted.groupBy("pattern", day).agg(F.sum("support").alias("contained"), F.sum("contiguous").alias("contiguous"), *[F.sum(F.when(F.col(hour) == h, F.col("support")).otherwise(0)).alias(f"hour_{h:02d}") for h in hours])
    sums = ["contained", "contiguous", *[f"hour_{h:02d}" for h in hours]]
    per = fan_out(one, day, scopes).groupBy("scope", "pattern").agg(*[F.sum(c).alias(c) for c in sums])
    distinct = patterns.select("pattern").distinct()
    at = distinct.select("pattern", F.posexplode("pattern").alias("i", "region")).join(codes.select("region", "code", "district"), "region")
    inorder = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda s: s[c]).alias(f"{c}s")
    names = at.groupBy("pattern").agg(inorder("code"), inorder("district"))
    steps = distinct.select("pattern", F.explode(F.transform(F.sequence(F.lit(1), F.size("pattern") - 1), lambda i: F.struct(F.least(F.element_at("pattern", i), F.element_at("pattern", i + 1)).alias("a"), F.greatest(F.element_at("pattern", i), F.element_at("pattern", i + 1)).alias("b")))).alias("s")).select("pattern", "s.*")
    adjacent = steps.join(adjacency.select("a", "b", F.lit(True).alias("ok")), ["a", "b"], "left").groupBy("pattern").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_steps_adjacent"))
    out = patterns.join(names, "pattern").join(adjacent, "pattern", "left").join(per, ["scope", "pattern"], "left")
    return out.fillna(0, sums)


def overlap_floor(sequences: int, share: float = 0.003) -> int:
    """Least support in comparisons between scopes of different size."""
    return math.ceil(share * sequences)


def mine(sequences: DataFrame, min_count: int, p: SequenceParams, column: str = "regions") -> DataFrame:
    """Frequent subsequences with gaps of 2 to ``max_length`` regions and their support; each sequence counts once."""
    from pyspark.ml.fpm import PrefixSpan

    n = sequences.count()
    if not n:
        return sequences.select(F.col(column).alias("pattern"), F.lit(0).cast("long").alias("support"))
    items = sequences.select(F.transform(column, lambda r: F.array(r)).alias("sequence"))
    found = PrefixSpan(minSupport=(min_count - 0.5) / n, maxPatternLength=p.max_length, sequenceCol="sequence").findFrequentSequentialPatterns(items)
    return found.select(F.flatten("sequence").alias("pattern"), F.col("freq").alias("support")).where(F.size("pattern") >= p.min_length)


def fan_out(rows: DataFrame, day: str, scopes: DataFrame) -> DataFrame:
    """Rows of each scope a day belongs to: scopes has (day, scope)."""
    return rows.join(F.broadcast(scopes), day)


def support_scan(patterns: DataFrame, rungs: Sequence[int]) -> DataFrame:
    """Patterns of each length whose support reaches each rung, from one table mined at the lowest."""
    steps = F.explode(F.array(*[F.lit(r).cast("long") for r in rungs])).alias("rung")
    return patterns.select("*", steps).where("support >= rung").groupBy("rung", F.size("pattern").alias("length")).agg(F.count("*").alias("patterns"), F.max("support").alias("top_support"))
