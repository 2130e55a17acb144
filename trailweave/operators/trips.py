"""Pairing alternating events into trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds
from ..params import TripParams


def pair_events(events: DataFrame, entity: Sequence[str], order: str, carry: Sequence[str]) -> DataFrame:
    """Even events opened, odd events closed: one row for each full pair, with columns open_* and close_*. A last event without partner is dropped.

    ``lead`` finds the partner in the same window that numbers the events, so
    there is no self-join.
    """
    w = Window.partitionBy(*entity).orderBy(order)
    numbered = events.withColumn("__n", F.row_number().over(w) - 1)
    ahead = numbered.select(*entity, "__n", *[F.col(c).alias(f"open_{c}") for c in carry], *[F.lead(c).over(w).alias(f"close_{c}") for c in carry], F.lead(F.lit(1)).over(w).alias("__there"))
    return ahead.where("__n % 2 = 0 and __there is not null").withColumn("trip_index", (F.col("__n") / 2).cast("long")).drop("__n", "__there")


def offenders(events: DataFrame, entity: Sequence[str], order: str, status: str) -> DataFrame:
    """Entities whose statuses do not alternate 0, 1, 0, 1, ... to an even end, with the number of wrong events and all events."""
    w = Window.partitionBy(*entity).orderBy(order)
    numbered = events.withColumn("__n", F.row_number().over(w) - 1)
    per = numbered.groupBy(*entity).agg(F.count("*").alias("events"), F.sum((F.col(status) != F.col("__n") % 2).cast("long")).alias("misplaced"))
    return per.where("misplaced > 0 or events % 2 = 1")


def judge_trips(pairs: DataFrame, p: TripParams, distance_col: str = "distance_m") -> DataFrame:
    """Duration, distance band and flags of pairs with open_ts and close_ts. Limits are exclusive."""
    near, far = p.band_edges_m
    out = pairs.withColumn("duration_s", seconds(F.col("close_ts")) - seconds(F.col("open_ts")))
    band = F.when(F.col(distance_col) < near, "short").when(F.col(distance_col) < far, "medium").otherwise("long")
    return out.withColumns({"band": band, "fails_duration": (F.col("duration_s") <= p.min_duration_s) | (F.col("duration_s") >= p.max_duration_s)}).withColumn("is_valid", ~F.col("fails_duration"))
