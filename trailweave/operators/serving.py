"""The queries that a map client sends."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import meets_polygon


class RequestError(ValueError):
    """A request outside its limits."""


def check_window(start: datetime, end: datetime, longest: timedelta = timedelta(hours=4)) -> None:
    """Half-open time windows within one day of at most the longest span."""
    if start >= end or end - start > longest or start.date() != (end - timedelta(microseconds=1)).date():
        raise RequestError("the window must lie within one day and be at most four hours long")


def check_box(box: Sequence[float]) -> None:
    if len(box) != 4 or box[0] >= box[2] or box[1] >= box[3]:
        raise RequestError("a box is west, south, east, north in order")


def flows(significance: DataFrame, observed: DataFrame, scope: str, scopes: Sequence[str], slot: int, stable: str = "stable") -> DataFrame:
    """Pairs of a scope with their weight in a time slot and their test. For the stable scope only tested pairs, with the mean weight of all scopes, absent ones counted as 0."""
    days = [scope] if scope != stable else list(scopes)
    w = observed.where(F.col("scope").isin(days) & (F.col("slot") == slot)).groupBy("from_region", "to_region").agg(F.sum("n").cast("double").alias("weight"))
    s = significance.where(F.col("scope") == scope).select("from_region", "to_region", "observed", "is_significant", "gated", "is_self_loop", F.lit(True).alias("is_tested"))
    joined = s.join(w, ["from_region", "to_region"], "left" if scope == stable else "outer")
    return joined.select(F.lit(scope).alias("scope"), F.lit(slot).alias("slot"), "from_region", "to_region", (F.coalesce("weight", F.lit(0.0)) / len(days)).alias("weight"), F.coalesce("is_tested", F.lit(False)).alias("is_tested"), "observed", "is_significant", "gated", "is_self_loop")


def check_selection(region: int | None, box: Sequence[float] | None) -> None:
    """A region or a box, not both and not neither."""
    if (region is None) == (box is None):
        raise RequestError("a selection is a region or a box")
    if box is not None:
        check_box(box)


def windowed_legs(points: DataFrame, key: Sequence[str], start, end, longest_s: float | None = None) -> DataFrame:
    """Legs of tracks within [start, end): key, t0, t1, x0, y0, x1, y1 and the part lo to hi of each leg that lies in the window.

    With ``longest_s``, the longest time between two points of a track, points
    further from the window are left out before tracks are put in order; a filter
    on the time of the table reaches the scan.
    """
    sec = lambda c: F.unix_micros(c.cast("timestamp"))
    s, e = sec(F.lit(start)), sec(F.lit(end))
    if longest_s is not None:
        reach = F.make_dt_interval(secs=F.lit(float(longest_s)))
        points = points.where((F.col("ts") >= F.lit(start) - reach) & (F.col("ts") < F.lit(end) + reach))
    w = Window.partitionBy(*key).orderBy("ts", "x", "y")
    legs = points.select(*key, F.lag("ts").over(w).alias("t0"), F.col("ts").alias("t1"), F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1")).where("t0 is not null")
    a, b = sec(F.col("t0")), sec(F.col("t1"))
    legs = legs.where((b >= s) & (a < e))
    lo = F.when(b > a, F.greatest(F.lit(0.0), (s - a) / (b - a))).otherwise(0.0)
    hi = F.when(b > a, F.least(F.lit(1.0), (e - a) / (b - a))).otherwise(1.0)
    return legs.withColumns({"lo": lo, "hi": hi})


def _answer(hits: DataFrame, key: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    hits = hits.select(*key).distinct()
    return hits.agg(F.count("*").alias("total")), hits.orderBy(*key).limit(max(0, min(limit, 200)))


def tracks_in_box(points: DataFrame, key: Sequence[str], box: Sequence[float], start, end, limit: int = 200, longest_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(total tracks, at most ``limit`` of them in order of key) with a leg that meets the box within [start, end).

    Legs are cut to the window by time and tested against the box exactly
    (Liang-Barsky), all in column expressions. Both answers share the plan up to
    the distinct tracks.
    """
    check_box(box)
    legs = windowed_legs(points, key, start, end, longest_s)
    lo, hi = F.col("lo"), F.col("hi")
    for p0, p1, low, high in (("x0", "x1", box[0], box[2]), ("y0", "y1", box[1], box[3])):
        d = F.col(p1) - F.col(p0)
        u, v = (low - F.col(p0)) / F.nullif(d, F.lit(0.0)), (high - F.col(p0)) / F.nullif(d, F.lit(0.0))
        within = (F.col(p0) >= low) & (F.col(p0) <= high)
        lo = F.when(d == 0, F.when(within, lo).otherwise(2.0)).otherwise(F.greatest(lo, F.least(u, v)))
        hi = F.when(d == 0, F.when(within, hi).otherwise(-1.0)).otherwise(F.least(hi, F.greatest(u, v)))
    return _answer(legs.where(lo <= hi), key, limit)


def clipped(legs: DataFrame) -> DataFrame:
    """Legs with the ends of their part in the window: cx0, cy0, cx1, cy1."""
    at = lambda c, t: F.col(f"{c}0") + F.col(t) * (F.col(f"{c}1") - F.col(f"{c}0"))
    return legs.withColumns({f"c{c}{i}": at(c, t) for c in "xy" for i, t in ((0, "lo"), (1, "hi"))})


def tracks_in_region(points: DataFrame, key: Sequence[str], polygon, start, end, limit: int = 200, longest_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``tracks_in_box``, for a region's polygon (rings of x, y): the box around it goes first, in columns; what is left is tested exactly."""
    xs, ys = [x for x, _ in polygon[0]], [y for _, y in polygon[0]]
    legs = clipped(windowed_legs(points, key, start, end, longest_s))
    low, high = (lambda c: F.least(f"c{c}0", f"c{c}1")), (lambda c: F.greatest(f"c{c}0", f"c{c}1"))
    near = legs.where((low("x") <= max(xs)) & (high("x") >= min(xs)) & (low("y") <= max(ys)) & (high("y") >= min(ys)))
    return _answer(near.where(meets_polygon(polygon)("cx0", "cy0", "cx1", "cy1")), key, limit)


def windowed_paths(points: DataFrame, sample: DataFrame, key: Sequence[str], start, end, longest_s: float | None = None) -> DataFrame:
    """The path of each sampled track within the window: key, path (array of x, y)."""
    legs = clipped(windowed_legs(points.join(F.broadcast(sample), list(key), "left_semi"), key, start, end, longest_s)).where("lo < hi or (lo = hi and t0 = t1)")
    ordered = F.sort_array(F.collect_list(F.struct("t0", "t1", "cx0", "cy0", "cx1", "cy1")))
    per = legs.groupBy(*key).agg(ordered.alias("l"))
    first = F.array(F.struct(F.col("l")[0]["cx0"].alias("x"), F.col("l")[0]["cy0"].alias("y")))
    return per.select(*key, F.concat(first, F.transform("l", lambda v: F.struct(v["cx1"].alias("x"), v["cy1"].alias("y")))).alias("path"))


def merge_samples(answers: Sequence[tuple[str, DataFrame, DataFrame]], key: Sequence[str], keep: int = 20) -> tuple[DataFrame, DataFrame]:
    """One answer from those of several days (day, total, sample): the sum of totals, and the first ``keep`` samples by day, then key."""
    from functools import reduce

    totals = reduce(DataFrame.union, [t.select("total") for _, t, _ in answers]).agg(F.sum("total").alias("total"))
    samples = reduce(DataFrame.union, [s.select(F.lit(day).alias("day"), *key) for day, _, s in answers])
    return totals, samples.orderBy("day", *key).limit(keep)


def top_sequences(patterns: DataFrame, scan: DataFrame, scope: str, min_support: float, limit: int) -> DataFrame:
    """Patterns of a scope whose steps are all between neighbours and whose contiguous support reaches the count that ``scan`` (scope, min_support, min_support_count) gives for the level: by contiguous support, then length, both falling, then pattern. A level that ``scan`` doesn't give once is an error."""
    rows = scan.where((F.col("scope") == scope) & (F.col("min_support") == min_support)).limit(2).collect()
    if len(rows) != 1:
        raise RequestError("no such level of support")
    fit = patterns.where((F.col("scope") == scope) & F.col("all_steps_adjacent") & (F.col("contiguous") >= rows[0]["min_support_count"]))
    return fit.orderBy(F.desc("contiguous"), F.desc(F.size("pattern")), "pattern").limit(max(0, min(limit, 100)))


def regions_payload(regions: DataFrame, metrics: DataFrame, key: str = "region", order: Sequence[str] = ("day", "hour")) -> DataFrame:
    """Regions in order with all columns, and their metrics as an array of structs in order of day and hour; a region without any has an empty one."""
    columns = [c for c in metrics.columns if c != key and c not in order]
    per = metrics.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("metrics"))
    out = regions.join(per, key, "left")
    return out.withColumn("metrics", F.coalesce("metrics", F.array().cast(dict(per.dtypes)["metrics"]))).orderBy(key)


def flow_requests(days: Sequence[str], clear: Sequence[str], scope: str, stable: bool, start_hour: int, end_hour: int) -> list[tuple[str, int]]:
    """(scope, hour) of each slice that a view of flows needs: for the merged scope the stable set or each clear day, for others each day of ``a..b``."""
    if scope == "clear-days":
        scopes = ["stable"] if stable else list(clear)
    else:
        first, _, last = scope.partition("..")
        scopes = [d for d in days_between(first, last or first) if d in days]
    return [(s, h) for s in scopes for h in range(start_hour, end_hour)]


def feature_collection(rows: DataFrame, geometry: str, id_: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON FeatureCollection in a row; ``geometry`` is an array of rings of [x, y]. For tables as small as a map."""
    f = F.struct(F.lit("Feature").alias("type"), F.col(id_).alias("id"), F.struct(F.lit("Polygon").alias("type"), F.col(geometry).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(id_).alias("k"), f.alias("f")))), lambda s: s["f"])
    return rows.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), ordered.alias("features"))).alias("geojson"))


def health(checks: dict[str, bool]) -> tuple[int, str]:
    """HTTP status and body: 200 only if every component is well."""
    return (200 if all(checks.values()) else 503), json.dumps({k: "ok" if v else "failed" for k, v in sorted(checks.items())})


def days_between(first: str, last: str) -> list[str]:
    """Dates of a scope ``a..b``."""
    a, b = (datetime.strptime(x, "%Y-%m-%d").date() for x in (first, last))
    return [(a + timedelta(days=i)).isoformat() for i in range((b - a).days + 1)]
