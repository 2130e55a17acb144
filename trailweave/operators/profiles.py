"""Dense hourly profiles, flow matrices and directional statistics of regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, sector

ZERO = 1e-12


def scaffold(dims: Sequence[DataFrame]) -> DataFrame:
    """Every combination of a few small dimension tables."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out


def dense(grid: DataFrame, facts: Sequence[DataFrame], keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """The scaffold with facts joined on and absent counts 0; ratios are left to the caller, null where undefined."""
    for f in facts:
        grid = grid.join(f, list(keys), "left")
    return grid.fillna(0, list(fill))


def transit_votes(visits: DataFrame, track: Sequence[str], order: Sequence[str], min_chord: float = 1.0) -> DataFrame:
    """One row for each track and distinct region: whether it was passed through (neither first nor last of the track) and the chord from first entry to last exit.

    ``visits`` has region, entry_x, entry_y, exit_x, exit_y. Direction terms are
    null unless the region was passed through by a chord of at least ``min_chord``.
    """
    at = F.struct(*order)
    per = visits.groupBy(*track, "region").agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.min_by(F.struct("entry_x", "entry_y"), at).alias("__in"), F.max_by(F.struct("exit_x", "exit_y"), at).alias("__out"))
    w = Window.partitionBy(*track)
    per = per.withColumn("is_transit", (F.col("__first") != F.min("__first").over(w)) & (F.col("__last") != F.max("__last").over(w)))
    per = per.withColumns({"dx": F.col("__out.exit_x") - F.col("__in.entry_x"), "dy": F.col("__out.exit_y") - F.col("__in.entry_y")})
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    counts = F.col("is_transit") & (length >= min_chord)
    c, s = F.col("dy") / length, F.col("dx") / length  # bearing from north, clockwise
    terms = {"sector": sector(F.col("dx"), F.col("dy")), "cos1": c, "sin1": s, "cos2": c * c - s * s, "sin2": 2 * s * c}
    return per.withColumns({k: F.when(counts, v) for k, v in terms.items()}).drop("__first", "__last", "__in", "__out")


def circular(votes: DataFrame, by: Sequence[str], sectors: int = 16) -> DataFrame:
    """Sums and directional statistics of transit votes: R, axial R, mean and axis bearing, and a count for each sector."""
    sums = votes.groupBy(*by).agg(
        F.count("*").cast("long").alias("visiting"),
        F.sum(F.col("is_transit").cast("long")).alias("transit"),
        F.count("sector").alias("chords"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"sum_{c}") for c in ("cos1", "sin1", "cos2", "sin2")],
        *[F.count_if(F.col("sector") == i).alias(f"sector_{i:02d}") for i in range(sectors)],
    )
    one = F.sqrt(F.col("sum_cos1") * F.col("sum_cos1") + F.col("sum_sin1") * F.col("sum_sin1"))
    two = F.sqrt(F.col("sum_cos2") * F.col("sum_cos2") + F.col("sum_sin2") * F.col("sum_sin2"))
    full = lambda v, n: F.pmod(v, F.lit(n))
    return sums.withColumns({
        "transit_rate": ratio(F.col("transit"), F.col("visiting")),
        "r": F.when(F.col("chords") > 0, F.least(F.lit(1.0), one / F.col("chords"))),
        "r_axial": F.when(F.col("chords") > 0, F.least(F.lit(1.0), two / F.col("chords"))),
        "mean_bearing": F.when(one > ZERO, full(F.degrees(F.atan2("sum_sin1", "sum_cos1")), 360.0)),
        "axis_bearing": F.when(two > ZERO, full(F.degrees(F.atan2("sum_sin2", "sum_cos2")) / 2, 180.0)),
    })


def flow_od(trips: DataFrame, by: Sequence[str], origin: str, target: str) -> DataFrame:
    """Trips between regions; trips without either end are left out. Time slots come from the start of the trip only."""
    return trips.where(F.col(origin).isNotNull() & F.col(target).isNotNull()).groupBy(*by, F.col(origin).alias("from_region"), F.col(target).alias("to_region")).agg(F.count("*").alias("trips"))


def transitions(visits: DataFrame, track: Sequence[str], order: str, cut: Column | None = None) -> DataFrame:
    """Neighbouring visits of a track that no cut parts: from_region and to_region with all columns of the later visit."""
    w = Window.partitionBy(*track).orderBy(order)
    out = visits.withColumns({"from_region": F.lag("region").over(w), "to_region": F.col("region")})
    kept = F.col("from_region").isNotNull() & (F.col("from_region") != F.col("to_region"))
    return out.where(kept if cut is None else kept & ~cut)


def flow_channel(moves: DataFrame, by: Sequence[str], track: Sequence[str]) -> DataFrame:
    """Tracks that made each move; each counts once."""
    return moves.dropDuplicates([*by, *track, "from_region", "to_region"]).groupBy(*by, "from_region", "to_region").agg(F.count("*").alias("tracks"))


def flow_track_od(visits: DataFrame, track: Sequence[str], order: str, by: Sequence[str]) -> DataFrame:
    """First to last region of each track."""
    ends = visits.groupBy(*track).agg(F.min_by("region", order).alias("from_region"), F.max_by("region", order).alias("to_region"), *[F.min_by(c, order).alias(c) for c in by if c not in track])
    return ends.groupBy(*by, "from_region", "to_region").agg(F.count("*").alias("tracks"))


def rank_codes(members: DataFrame, group: str, size: str, id_: str) -> DataFrame:
    """Code such as ``2-01``: the group and the member's rank by size, ties by id."""
    w = Window.partitionBy(group).orderBy(F.desc(size), F.col(id_))
    return members.withColumn("code", F.concat_ws("-", F.col(group).cast("string"), F.lpad(F.row_number().over(w).cast("string"), 2, "0")))
