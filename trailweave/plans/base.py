"""Tables of the test data seen through the operators' eyes, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tracks import split_tracks
from ..params import SplitParams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPLIT = SplitParams(max_gap_s=6 * 3600, max_speed_mps=12.0, max_step_m=5000.0)
CELL = 600.0


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that checks it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: x = 10 * value, y = 30 * k."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", k.alias("k"), (F.col("value") * 10.0).alias("x"), (k * 30.0).cast("double").alias("y"), F.to_date("ts").alias("d"))


E = """e AS (
  SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         value * 10.0 AS x, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 30.0 AS DOUBLE) AS y,
         CAST(ts AS DATE) AS d, CAST(floor(epoch(ts)) AS BIGINT) AS t
  FROM events)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with session number s (from 1, by user), gap_s, step_m and speed_mps."""
    return split_tracks(events(spark, sf_dir), SPLIT, ["user_id"], "event_id").withColumnRenamed("track_no", "s")


WALK_X, WALK_Y = 5000.0, 3000.0


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long track of each user: events as small steps from the middle of the map, folded back at its borders. At sf0.1 a track has some 67 points, 50 m apart."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    fold = lambda step, size: F.lit(size) - F.abs(F.pmod(F.lit(size / 2) + F.sum(step).over(w), F.lit(2 * size)) - size)
    return events(spark, sf_dir).select("user_id", "event_id", "ts", fold((F.col("value") - 50.0) * 0.8, WALK_X).alias("x"), fold(F.col("k") - 50.0, WALK_Y).alias("y"))


SESS = E + """, lagged AS (
  SELECT *, t - lag(t) OVER w AS g, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS st
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), flagged AS (
  SELECT *, CASE WHEN g IS NULL OR g <= 0 OR g > 21600 OR st / g > 12.0 OR st > 5000.0 THEN 1 ELSE 0 END AS new FROM lagged
), sess AS (
  SELECT event_id, user_id, ts, event_type, value, k, x, y, d, t,
         CASE WHEN new = 0 THEN g END AS gap_s, CASE WHEN new = 0 THEN st END AS step_m, CASE WHEN new = 0 THEN st / g END AS speed_mps,
         CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s
  FROM flagged)"""


def _orders_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation of their customer: joined before lines come in, so that lines are shuffled once for both."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("from_region"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


def flow_counts(spark: SparkSession, sf_dir: str, *by: str, band=None) -> DataFrame:
    """Lines by time and band between nations, as trips. Lines are counted for each supplier before suppliers come in."""
    keys = [*by, *(["band"] if band is not None else [])]
    o = _orders_of_nations(spark, sf_dir)
    o = o.withColumn("band", band) if band is not None else o
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    per = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(*keys, "from_region", "l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("to_region"))
    return per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(*keys, "from_region", "to_region").agg(F.sum("n").alias("trips"))


OD_ROWS = """od_rows AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, c_nationkey AS from_region, s_nationkey AS to_region, o_totalprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def year_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_counts(spark, sf_dir, "year")


OD = OD_ROWS + """, od AS (
  SELECT year, from_region, to_region, count(*) AS trips FROM od_rows GROUP BY ALL)"""


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that the order of a sum cannot show."""
    return df.select(*[F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
