"""One day against the mean of others, with every total divided by its exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import average_rank, cosine, safe_corr


def exposure_ratios(counts: DataFrame, exposure: DataFrame, day, clear: Sequence) -> DataFrame:
    """(band, ratio): the day's total for its exposure over the mean of that of the clear days, for each band and all together. Null if an exposure is 0 or a side is missing; a clear day without rows of a band counts as 0."""
    days = [day, *clear]
    x = exposure.where(F.col("day").isin(days)).select("day", "exposure")
    by = counts.where(F.col("day").isin(days)).groupBy("day", "band").agg(F.sum("n").alias("n"))
    by = by.union(by.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.lit("all"), "n"))
    every = by.select("band").distinct().crossJoin(F.broadcast(x))
    rates = every.join(by, ["day", "band"], "left").withColumn("rate", F.when(F.col("exposure") > 0, F.coalesce("n", F.lit(0)) / F.col("exposure")))
    own, mean = F.max(F.when(F.col("day") == day, F.col("rate"))), F.avg(F.when(F.col("day") != day, F.col("rate")))
    return rates.groupBy("band").agg(F.when(mean > 0, own / mean).alias("ratio"))


def day_contrast(counts: DataFrame, exposure: DataFrame, day, clear: Sequence, deviations: DataFrame | None = None) -> DataFrame:
    """Long records (metric, band, value, n) of a day against the clear days.

    ``counts`` has day, band, from_region, to_region, n; ``exposure`` day and
    exposure. Records: exposure_ratio of each band and of all; band_spread, the
    range of the bands' ratios; band_furthest, the band furthest from their mean
    (ties to the smaller name) with its distance; share_spearman and share_cosine
    of the shares of pairs between regions against those of all clear days
    together, absent pairs 0; self_loop_ratio, the share that stays in a region
    over the mean of the clear days; and each row of ``deviations`` (metric,
    value) as it is.
    """
    days = [day, *clear]
    rows = counts.where(F.col("day").isin(days))
    ratios = exposure_ratios(counts, exposure, day, clear)
    none = F.lit(None).cast("string")
    record = lambda df, metric, band, value: df.select(F.lit(metric).alias("metric"), band.alias("band"), value.alias("value"))
    bands = ratios.where("band <> 'all'")
    total = bands.agg((F.max("ratio") - F.min("ratio")).alias("spread"), F.avg("ratio").alias("mean"), F.collect_list(F.struct("band", "ratio")).alias("r"))
    far = total.select(F.array_min(F.transform("r", lambda v: F.struct((-F.abs(v["ratio"] - F.col("mean"))).alias("off"), v["band"].alias("band")))).alias("f"))
    apart = rows.where("from_region <> to_region").groupBy("from_region", "to_region").agg(F.sum(F.when(F.col("day") == day, F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("day") != day, F.col("n")).otherwise(0)).alias("y"))
    # Pairs of regions are as many as the map has; their sums are one row.
    sums = apart.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    shares = apart.crossJoin(F.broadcast(sums)).select(F.lit(1).alias("g"), F.when(F.col("sx") > 0, F.col("x") / F.col("sx")).otherwise(0.0).alias("a"), F.when(F.col("sy") > 0, F.col("y") / F.col("sy")).otherwise(0.0).alias("b"))
    ranked = average_rank(average_rank(shares, ["g"], "a", "ra"), ["g"], "b", "rb").agg(safe_corr(F.col("ra"), F.col("rb")).alias("s"), cosine(F.col("a"), F.col("b")).alias("c"))
    stay = rows.groupBy("day").agg((F.sum(F.when(F.col("from_region") == F.col("to_region"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    loop = stay.agg(F.max(F.when(F.col("day") == day, F.col("share"))).alias("own"), F.avg(F.when(F.col("day") != day, F.col("share"))).alias("mean"))
    out = record(ratios, "exposure_ratio", F.col("band"), F.col("ratio"))
    for more in (record(total, "band_spread", none, F.col("spread")), record(far, "band_furthest", F.col("f.band"), -F.col("f.off")), record(ranked, "share_spearman", none, F.col("s")), record(ranked, "share_cosine", none, F.col("c")), record(loop, "self_loop_ratio", none, F.when(F.col("mean") > 0, F.col("own") / F.col("mean")))):
        out = out.union(more)
    return out.union(deviations.select("metric", none, F.col("value").cast("double"))) if deviations is not None else out


def channel_stats(visits: DataFrame, track: Sequence[str], order: Sequence[str], piece: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(pairs, totals) of debounced visits: tracks that go from region to region within a piece without a gap, each once for a pair; and tracks, tracks with a piece of two visits or more, and their share."""
    w = Window.partitionBy(*track, *piece).orderBy(*order)
    moves = visits.withColumns({"from_region": F.lag("region").over(w), "to_region": F.col("region")}).where("from_region is not null and not gap_before")
    pairs = moves.select(*track, "from_region", "to_region").distinct().groupBy("from_region", "to_region").agg(F.count("*").alias("tracks"))
    per = visits.groupBy(*track, *piece).agg(F.count("*").alias("n")).groupBy(*track).agg((F.max("n") >= 2).alias("crosses"))
    totals = per.agg(F.count("*").alias("tracks"), F.count_if("crosses").alias("crossing"))
    return pairs, totals.withColumn("crossing_share", F.when(F.col("tracks") > 0, F.col("crossing") / F.col("tracks")))
