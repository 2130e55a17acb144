"""Splitting ordered event logs into tracks, and judging the tracks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import distance, seconds
from ..params import SplitParams, TrackFilterParams


def split_tracks(points: DataFrame, p: SplitParams, entity: Sequence[str] = ("entity",), order: str = "source_row", ts: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """Adds gap_s, step_m, speed_mps (null on a track's first point) and track_no, from 1, within each entity.

    A track begins where there is no point before, where time does not advance,
    and after too long a gap, too fast a move or too long a step. One shuffle on
    the entity serves all windows.
    """
    w = Window.partitionBy(*entity).orderBy(order)
    before = points.withColumns({"__t": seconds(F.lag(ts).over(w)), "__x": F.lag(x).over(w), "__y": F.lag(y).over(w)})
    gap = seconds(F.col(ts)) - F.col("__t")
    step = distance(F.col("__x"), F.col("__y"), F.col(x), F.col(y))
    moved = before.withColumns({"gap_s": gap, "step_m": step}).withColumn("speed_mps", F.expr("try_divide(step_m, gap_s)"))
    start = F.col("__t").isNull() | (F.col("gap_s") <= 0) | (F.col("gap_s") > p.max_gap_s) | (F.col("speed_mps") > p.max_speed_mps) | (F.col("step_m") > p.max_step_m)
    out = moved.withColumn("__start", F.coalesce(start, F.lit(True)))
    out = out.withColumn("track_no", F.sum(F.col("__start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumns({c: F.when(~F.col("__start"), F.col(c)) for c in ("gap_s", "step_m", "speed_mps")}).drop("__t", "__x", "__y", "__start")


#: Points up to which a track's range compares all pairs in columns; beyond, its hull does the same in Arrow batches.
FEW = 24


def largest_distance(points: Column) -> Column:
    """Largest distance between any two of an array of structs (x, y)."""
    far = F.transform(points, lambda a: F.array_max(F.transform(points, lambda b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))))
    return F.sqrt(F.array_max(far))


def hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the convex hull of points (monotone chain). Points within the octagon of the extreme points are left out first."""
    if len(x) > 64:
        at = np.unique([f(v) for v in (x, y, x + y, x - y) for f in (np.argmin, np.argmax)])
        mid = np.arctan2(y[at] - y[at].mean(), x[at] - x[at].mean())
        corner = at[np.argsort(mid)]
        inside = np.ones(len(x), bool)
        for i, j in zip(corner, np.roll(corner, -1), strict=True):
            inside &= (x[j] - x[i]) * (y - y[i]) - (y[j] - y[i]) * (x - x[i]) > 0
        keep = ~inside
        keep[at] = True
        x, y = x[keep], y[keep]
    order = np.lexsort((y, x))
    points = list(zip(x[order].tolist(), y[order].tolist(), strict=True))
    out: list[tuple[float, float]] = []
    for line in (points, points[::-1]):
        chain: list[tuple[float, float]] = []
        for p in line:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        out += chain[:-1] or chain
    xs, ys = np.array(out).T
    return xs, ys


def diameter(x: np.ndarray, y: np.ndarray) -> float:
    """Largest distance between two of the points: the farthest pair lies on the hull."""
    x, y = hull(x, y)
    best = 0.0
    step = max(1, (1 << 20) // len(x))
    for a in range(0, len(x), step):
        dx, dy = np.subtract.outer(x[a : a + step], x), np.subtract.outer(y[a : a + step], y)
        best = max(best, float((dx * dx + dy * dy).max()))
    return math.sqrt(best)


@F.pandas_udf(DoubleType())
def hull_diameter(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """``diameter`` of each row's arrays; null for null."""
    return pd.Series([None if x is None else diameter(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys, strict=True)], dtype="float64")


def _judged(grouped, p: TrackFilterParams, ts: str, inside: str | None, *more: Column) -> DataFrame:
    """Tracks with their figures and flags from grouped points, and more aggregates."""
    agg = grouped.agg(
        F.count("*").alias("points"),
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("length_m"),
        F.coalesce(F.avg((F.col("speed_mps") < p.slow_speed_mps).cast("double")), F.lit(1.0)).alias("slow_share"),
        (F.bool_and(inside) if inside else F.lit(True)).alias("all_inside"),
        F.collect_set(F.struct("x", "y")).alias("__xy"),
        *more,
    )
    agg = agg.withColumn("duration_s", seconds(F.col("end_time")) - seconds(F.col("start_time")))
    many = lambda c: F.when(F.size("__xy") > FEW, F.transform("__xy", lambda q: q[c]))
    agg = agg.withColumn("__far", hull_diameter(many("x"), many("y")))
    agg = agg.withColumn("range_m", F.when(F.size("__xy") <= FEW, largest_distance(F.col("__xy"))).otherwise(F.col("__far")))
    agg = agg.withColumn("mean_speed_mps", F.when(F.col("duration_s") > 0, F.col("length_m") / F.col("duration_s")).otherwise(F.lit(float("inf")))).drop("__xy", "__far")
    flags = {
        "fails_points": F.col("points") < p.min_points,
        "fails_duration": (F.col("duration_s") <= p.min_duration_s) | (F.col("duration_s") >= p.max_duration_s),
        "fails_inside": ~F.col("all_inside"),
        "fails_range": F.col("range_m") < p.min_range_m,
        "fails_slow": F.col("slow_share") > p.max_slow_share,
        "fails_speed": F.col("mean_speed_mps") > p.max_mean_speed_mps,
    }
    out = agg.withColumns(flags)
    fails = F.lit(False)
    for f in flags:
        fails = fails | F.col(f)
    return out.withColumn("is_valid", ~fails)


def track_table(points: DataFrame, p: TrackFilterParams, key: Sequence[str], order: str = "source_row", ts: str = "ts", inside: str | None = None) -> DataFrame:
    """One row for each track: size, times, range, shares, and each filter's flag, independent of the others. The range is the largest distance between any two points, exact at every length."""
    return _judged(points.groupBy(*key), p, ts, inside)


def mark_points(points: DataFrame, p: TrackFilterParams, key: Sequence[str], keep: Sequence[str], ts: str = "ts", inside: str | None = None) -> DataFrame:
    """Points (key and ``keep``) with is_valid_track of their track: points are gathered with their track once and dealt out again, so that they are split once and never joined."""
    held = _judged(points.groupBy(*key), p, ts, inside, F.collect_list(F.struct(*keep)).alias("__points"))
    return held.select(*key, F.col("is_valid").alias("is_valid_track"), F.inline("__points"))


def funnel(rows: DataFrame, flags: Sequence[tuple[str, str]], by: Sequence[str], weight: str) -> DataFrame:
    """Entered, kept and rejected rows at each stage, and their weights, when ``flags`` (stage, failing column) apply in turn.

    All stages are counted in one pass over the rows; a stack turns the wide
    counts into rows.
    """
    sums, alive = [], F.lit(True)
    for i, (_, flag) in enumerate(flags):
        sums += [F.sum(alive.cast("long")).alias(f"e{i}"), F.sum(F.when(alive, F.col(weight)).otherwise(0)).cast("long").alias(f"we{i}")]
        alive = alive & ~F.col(flag)
        sums += [F.sum(alive.cast("long")).alias(f"k{i}"), F.sum(F.when(alive, F.col(weight)).otherwise(0)).cast("long").alias(f"wk{i}")]
    wide = rows.groupBy(*by).agg(*sums)
    parts = ", ".join(f"{i}, '{name}', e{i}, k{i}, e{i} - k{i}, we{i}, wk{i}, we{i} - wk{i}" for i, (name, _) in enumerate(flags))
    return wide.selectExpr(*by, f"stack({len(flags)}, {parts}) AS (stage_index, stage_name, entered, kept, rejected, weight_entered, weight_kept, weight_rejected)")


def wide_funnel(wide: DataFrame, stages: Sequence[tuple[str, str, str]], by: Sequence[str]) -> DataFrame:
    """Rows (stage, entered, kept, rejected) from columns that hold the counts."""
    parts = ", ".join(f"{i}, '{n}', {a}, {b}, {a} - {b}" for i, (n, a, b) in enumerate(stages))
    return wide.selectExpr(*by, f"stack({len(stages)}, {parts}) AS (stage_index, stage_name, entered, kept, rejected)")


def forward_fill(rows: DataFrame, order: str, column: str, bucket: int = 65536) -> DataFrame:
    """The last value that is neither null nor blank at or before each row in the order, without sorting all rows in one place.

    Rows fall into buckets of the order's range. Only the last value of each
    bucket crosses buckets; that table has one row for each bucket.
    """
    value = F.when(F.trim(F.col(column)) != "", F.col(column))
    held = rows.withColumns({"__b": F.floor(F.col(order) / bucket), "__v": value})
    last = held.where("__v is not null").groupBy("__b").agg(F.max_by("__v", order).alias("__last"))
    buckets = held.select("__b").distinct().join(last, "__b", "left")
    carry = buckets.withColumn("__carry", F.last("__last", ignorenulls=True).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", "__carry")
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(carry, "__b").withColumn(column, F.coalesce(F.last("__v", ignorenulls=True).over(w), F.col("__carry")))
    return out.drop("__b", "__v", "__carry")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, value: str) -> DataFrame:
    """The right side's last value at or before each left row's time, within the keys. One union and one window instead of a range join."""
    a = left.select("*", F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(*keys, F.col(when).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__t", "__side", "__v")


def islands(rows: DataFrame, key: Sequence[str], order: str, value: Sequence[str], weight: str) -> DataFrame:
    """Runs of equal neighbouring values: their number, size, weight, and the weight that went before."""
    w = Window.partitionBy(*key).orderBy(order)
    same = F.lit(True)
    for v in value:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(w))
    marked = rows.withColumn("__new", F.when(F.row_number().over(w) == 1, True).otherwise(~same)).withColumn("run_index", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    runs = marked.groupBy(*key, "run_index", *value).agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"))
    before = F.sum("weight").over(Window.partitionBy(*key).orderBy("run_index").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("before", F.coalesce(before, F.lit(0.0)))
