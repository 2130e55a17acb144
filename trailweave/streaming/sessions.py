"""Streaming twins of the batch operators; the batch ones are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, entity: str, ts: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions by gap of a stream, emitted once the watermark passes their end."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), entity).agg(F.count("*").alias("points"))
    return s.select(entity, F.col("s.start").alias("start_time"), F.col("s.end").alias("end_time"), "points")


def open_sessions(spark: SparkSession, checkpoint: str, entity: str) -> DataFrame:
    """Sessions that a stopped ``gap_sessions`` query still holds, from the state in its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col(f"value.{entity}").alias(entity), F.col("value.session_window.start").alias("start_time"), F.col("value.session_window.end").alias("end_time"), F.col("value.count").alias("points"))


def all_sessions(events: DataFrame, entity: str, ts: str, folder: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Every session of what a stream holds now: those that the watermark closed, written to ``folder`` (which driver and executors share), and those still open. Called again with the same folder it goes on with what came since."""
    spark = events.sparkSession
    out, state = f"{folder}/sessions", f"{folder}/state"
    query = gap_sessions(events, entity, ts, gap, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    kind = "timestamp"
    closed = spark.read.schema(f"{entity} {dict(events.dtypes)[entity]}, start_time {kind}, end_time {kind}, points long").parquet(out)
    return closed.unionByName(open_sessions(spark, state, entity))


def hourly_counts(events: DataFrame, ts: str, by: str, late: str = "1 hour") -> DataFrame:
    """Events of each hour and kind."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("hour"), by, "n")


def pair_streams(opened: DataFrame, closed: DataFrame, entity: str, ts: str, longest: str = "1 hour") -> DataFrame:
    """Opening and closing events of an entity within the longest time, joined as they arrive."""
    a = opened.select(F.col(entity).alias("entity"), F.col(ts).alias("open_ts")).withWatermark("open_ts", longest)
    b = closed.select(F.col(entity).alias("b_entity"), F.col(ts).alias("close_ts")).withWatermark("close_ts", longest)
    return a.join(b, F.expr(f"entity = b_entity AND close_ts > open_ts AND close_ts <= open_ts + INTERVAL {longest}")).drop("b_entity")
