"""Debouncing crossings into visits, in windows over each piece.

What a span does depends on itself and on the spans before it only: whether it is
long enough or holds enough matched points is settled by its own bounds, so one
pass from left to right reaches the fixed point, and windows express it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DebounceParams


def spans(crossings: DataFrame, key: Sequence[str]) -> DataFrame:
    """Crossings of a piece merged where neighbours share a region (or have none): span, region, length_m, entry and exit, and the mileage start_m to end_m."""
    w = Window.partitionBy(*key).orderBy("run_index")
    other = F.coalesce(~F.col("region").eqNullSafe(F.lag("region").over(w)), F.lit(False)) & (F.row_number().over(w) > 1)
    marked = crossings.withColumn("__new", other.cast("int")).withColumn("span", F.sum("__new").over(w))
    marked = marked.withColumn("__until", F.sum("length_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = (lambda c: F.min_by(c, "run_index").alias(c)), (lambda c: F.max_by(c, "run_index").alias(c))
    merged = marked.groupBy(*key, "span").agg(F.first("region").alias("region"), F.sum("length_m").alias("length_m"), first("entry_x"), first("entry_y"), last("exit_x"), last("exit_y"), F.max_by("__until", "run_index").alias("end_m"))
    return merged.withColumn("start_m", F.coalesce(F.lag("end_m").over(Window.partitionBy(*key).orderBy("span")), F.lit(0.0)))


def points_within(rows: DataFrame, offsets: DataFrame, key: Sequence[str]) -> DataFrame:
    """``spans`` with ``points``: matched offsets from start_m up to, not with, end_m; a span that ends with the piece takes all from its start on. Span starts and offsets meet in one sorted pass instead of an interval join."""
    starts = rows.select(*key, F.col("start_m").alias("__at"), F.lit(0).alias("__kind"), F.struct(*[c for c in rows.columns if c not in key]).alias("__row"))
    marks = offsets.where("offset_m is not null").join(rows.select(*key).distinct(), list(key), "left_semi").select(*key, F.col("offset_m").alias("__at"), F.lit(1).alias("__kind"))
    w = Window.partitionBy(*key).orderBy("__at", "__kind", "__row.span")
    both = starts.unionByName(marks, allowMissingColumns=True)
    both = both.withColumns({"__before": F.sum("__kind").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__kind").over(Window.partitionBy(*key))})
    flat = both.where("__kind = 0").select(*key, "__row.*", "__before", "__all")
    after = F.lead("__before").over(Window.partitionBy(*key).orderBy("span"))
    total = F.max("end_m").over(Window.partitionBy(*key))
    return flat.withColumn("points", F.when(F.col("end_m") >= total - 1e-9, F.col("__all")).otherwise(after) - F.col("__before")).drop("__before", "__all")


def debounce_pieces(crossings: DataFrame, offsets: DataFrame, key: Sequence[str], p: DebounceParams) -> DataFrame:
    """Visits of every piece: key, visit_index, region, length_m, entry and exit, gap_before.

    A span counts if it is ``min_length_m`` long or holds ``min_match_points``
    matched points. One without region that counts cuts: the next visit begins
    anew and says gap_before, also at the beginning of a piece. One with a region
    that counts is a visit, or goes on with the visit before it if that has the
    same region and no cut stands between. Any other span joins the visit before
    it unless there is none or a cut came after it; then it is dropped. Crossings
    are (key, run_index, region or null, length_m, entry_x, entry_y, exit_x,
    exit_y), offsets (key, offset_m).
    """
    rows = points_within(spans(crossings, key), offsets, key)
    counts = (F.col("length_m") >= p.min_length_m) | (F.col("points") >= p.min_match_points)
    w = Window.partitionBy(*key).orderBy("span")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # The region of the last span that counted, null if that was a cut; ``some`` tells a cut from none at all.
    rows = rows.withColumns({"__counts": counts, "__mark": F.when(counts, F.struct("region"))})
    rows = rows.withColumn("__last", F.last("__mark", ignorenulls=True).over(before))
    cut_before = F.col("__last").isNotNull() & F.col("__last.region").isNull()
    good = F.col("__counts") & F.col("region").isNotNull()
    begins = good & ~F.coalesce(F.col("__last.region") == F.col("region"), F.lit(False))
    rows = rows.withColumns({"__gap": cut_before, "__begins": begins, "__part": good | (~F.col("__counts") & F.col("__last.region").isNotNull())})
    rows = rows.withColumn("visit_index", F.sum(F.col("__begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("__part")
    first, last = (lambda c: F.min_by(c, "span").alias(c)), (lambda c: F.max_by(c, "span").alias(c))
    out = rows.groupBy(*key, "visit_index").agg(first("region"), F.sum("length_m").alias("length_m"), first("entry_x"), first("entry_y"), last("exit_x"), last("exit_y"), F.min_by("__gap", "span").alias("gap_before"))
    return out.select(*key, F.col("visit_index").cast("int").alias("visit_index"), "region", "length_m", "entry_x", "entry_y", "exit_x", "exit_y", "gap_before")


def piece_cuts(crossings: DataFrame, offsets: DataFrame, key: Sequence[str], p: DebounceParams) -> DataFrame:
    """For each piece its spans before debouncing, its visits and its cuts: one for each visit after a cut and one if a cut follows the last visit."""
    rows = points_within(spans(crossings, key), offsets, key)
    counts = (F.col("length_m") >= p.min_length_m) | (F.col("points") >= p.min_match_points)
    ends = rows.groupBy(*key).agg(F.count("*").alias("candidates"), F.max_by(F.col("region").isNull(), F.when(counts, F.col("span"))).alias("__ends"))
    visits = debounce_pieces(crossings, offsets, key, p).groupBy(*key).agg(F.count("*").alias("visits"), F.count_if("gap_before").alias("__gaps"))
    out = ends.join(visits, list(key), "left").fillna(0, ["visits", "__gaps"])
    return out.select(*key, "candidates", "visits", (F.col("__gaps") + (F.coalesce("__ends", F.lit(False)) & (F.col("visits") > 0)).cast("int")).alias("cuts"))
