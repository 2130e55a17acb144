"""Queries on tracks, trips, grids and visits of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import second_of_day, seconds
from ..operators import grid, profiles, sequences, spatial, tracks, trips
from ..params import MatchParams, SequenceParams, TrackFilterParams, TripParams
from .base import CELL, E, SESS, events, query, rounded, sessions

FILTERS = TrackFilterParams(min_points=2, min_duration_s=600, max_duration_s=36000, min_range_m=500.0, slow_speed_mps=0.05, max_slow_share=0.6, max_mean_speed_mps=0.5)
KEY = ["user_id", "s"]


@query(
    f"WITH {SESS} SELECT event_id, user_id, s, CAST(gap_s AS BIGINT) AS gap_s, round(step_m, 6) AS step_m, round(speed_mps, 6) AS speed_mps FROM sess"
)
def gap_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sessions(spark, sf).select("event_id", "user_id", "s", "gap_s", "step_m", "speed_mps"))


ROLL = SESS + """, far AS (
  SELECT a.user_id, a.s, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS range_m
  FROM sess a JOIN sess b USING (user_id, s) GROUP BY ALL
), agg AS (
  SELECT user_id, s, count(*) AS points, min(ts) AS start_time, max(ts) AS end_time, max(t) - min(t) AS duration_s, coalesce(sum(step_m), 0.0) AS length_m,
         coalesce(avg(CASE WHEN speed_mps < 0.05 THEN 1.0 WHEN speed_mps IS NOT NULL THEN 0.0 END), 1.0) AS slow_share
  FROM sess GROUP BY user_id, s
), roll AS (
  SELECT agg.*, range_m, CASE WHEN duration_s > 0 THEN length_m / duration_s ELSE CAST('inf' AS DOUBLE) END AS mean_speed_mps,
         points < 2 AS fails_points, duration_s <= 600 OR duration_s >= 36000 AS fails_duration, range_m < 500.0 AS fails_range, slow_share > 0.6 AS fails_slow,
         CASE WHEN duration_s > 0 THEN length_m / duration_s ELSE CAST('inf' AS DOUBLE) END > 0.5 AS fails_speed
  FROM agg JOIN far USING (user_id, s)
), valid AS (SELECT *, NOT (fails_points OR fails_duration OR fails_range OR fails_slow OR fails_speed) AS is_valid FROM roll)"""


def session_table(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.track_table(sessions(spark, sf), FILTERS, KEY, "event_id")


@query(
    f"""WITH {ROLL} SELECT user_id, s, points, CAST(duration_s AS BIGINT) AS duration_s, round(length_m, 4) AS length_m, round(slow_share, 6) AS slow_share,
    CASE WHEN duration_s > 0 THEN round(mean_speed_mps, 6) END AS mean_speed_mps, fails_points, fails_duration, fails_range, fails_slow, fails_speed, is_valid FROM valid"""
)
def session_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = session_table(spark, sf).withColumn("mean_speed_mps", F.when(F.col("duration_s") > 0, F.col("mean_speed_mps")))
    return rounded(t.select(*KEY, "points", "duration_s", "length_m", "slow_share", "mean_speed_mps", "fails_points", "fails_duration", "fails_range", "fails_slow", "fails_speed", "is_valid"), length_m=4)


@query(f"WITH {ROLL} SELECT user_id, s, round(range_m, 6) AS range_m FROM valid")
def session_range(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(session_table(spark, sf).select(*KEY, "range_m"))


STAGES = [("points", "fails_points"), ("duration", "fails_duration"), ("range", "fails_range"), ("slow", "fails_slow"), ("speed", "fails_speed")]


def _funnel_sql() -> str:
    alive, parts = "TRUE", []
    for i, (name, flag) in enumerate(STAGES):
        after = f"({alive} AND NOT {flag})"
        n = lambda c: f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT)"
        w = lambda c: f"CAST(coalesce(sum(points) FILTER (WHERE {c}), 0) AS BIGINT)"
        parts.append(f"SELECT d, {i} AS stage_index, '{name}' AS stage_name, {n(alive)} AS entered, {n(after)} AS kept, {n(alive)} - {n(after)} AS rejected, {w(alive)} AS weight_entered, {w(after)} AS weight_kept, {w(alive)} - {w(after)} AS weight_rejected FROM v GROUP BY d")
        alive = after
    return f"WITH {ROLL}, v AS (SELECT *, CAST(start_time AS DATE) AS d FROM valid) " + " UNION ALL ".join(parts)


@query(_funnel_sql())
def filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.funnel(session_table(spark, sf).withColumn("d", F.to_date("start_time")), STAGES, ["d"], "points")


@query(f"WITH {ROLL} SELECT event_id, user_id, s, is_valid AS is_valid_track FROM sess JOIN valid USING (user_id, s)")
def mark_points(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.mark_points(sessions(spark, sf), FILTERS, KEY, ["event_id"]).select("event_id", *KEY, "is_valid_track")


@query(f"WITH {SESS} SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS event_type FROM sess")
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    blanked = events(spark, sf).select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).when(F.col("event_id") % 7 == 1, F.lit("  ")).alias("event_type"))
    return tracks.forward_fill(blanked, "event_id", "event_type", 4096).select("event_id", "event_type")


@query(
    f"""WITH {E}, marks AS (SELECT user_id, ts AS at, max(event_id) AS mark FROM e WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT e.event_id, e.user_id, m.mark FROM e ASOF LEFT JOIN marks m ON e.user_id = m.user_id AND e.ts >= m.at"""
)
def asof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    marks = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("mark"))
    return tracks.asof_join(e.select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "at", "mark").select("event_id", "user_id", "mark")


PAIRS = E + """, numbered AS (
  SELECT *, row_number() OVER w - 1 AS n, lead(t) OVER w AS close_t, lead(x) OVER w AS close_x, lead(y) OVER w AS close_y, lead(event_id) OVER w AS close_id, lead(ts) OVER w AS close_ts
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), pairs AS (
  SELECT user_id, n // 2 AS trip_index, event_id AS open_event_id, close_id AS close_event_id, ts AS open_ts, close_ts, close_t - t AS duration_s, x AS open_x, y AS open_y, close_x, close_y,
         sqrt((close_x - x) * (close_x - x) + (close_y - y) * (close_y - y)) AS distance_m
  FROM numbered WHERE n % 2 = 0 AND close_id IS NOT NULL)"""

TRIPS = TripParams(min_duration_s=600, max_duration_s=86400)


def trip_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalars import distance

    pairs = trips.pair_events(events(spark, sf), ["user_id"], "event_id", ["event_id", "ts", "x", "y"])
    pairs = pairs.withColumn("distance_m", distance(F.col("open_x"), F.col("open_y"), F.col("close_x"), F.col("close_y")))
    return trips.judge_trips(pairs, TRIPS)


@query(
    f"""WITH {PAIRS} SELECT user_id, CAST(trip_index AS BIGINT) AS trip_index, open_event_id, close_event_id, CAST(duration_s AS BIGINT) AS duration_s, round(distance_m, 6) AS distance_m,
    CASE WHEN distance_m < 1000 THEN 'short' WHEN distance_m < 3000 THEN 'medium' ELSE 'long' END AS band, NOT (duration_s <= 600 OR duration_s >= 86400) AS is_valid FROM pairs"""
)
def pair_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trip_rows(spark, sf).select("user_id", "trip_index", "open_event_id", "close_event_id", "duration_s", "distance_m", "band", "is_valid"))


@query(
    f"""WITH {E}, n AS (SELECT user_id, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM e)
    SELECT user_id, count(*) AS events, CAST(count(*) FILTER (WHERE status <> n % 2) AS BIGINT) AS misplaced FROM n GROUP BY user_id HAVING count(*) FILTER (WHERE status <> n % 2) > 0 OR count(*) % 2 = 1"""
)
def alternation_check(spark: SparkSession, sf: str) -> DataFrame:
    return trips.offenders(events(spark, sf).withColumn("status", F.col("k") % 2), ["user_id"], "event_id", "status")


@query(
    f"""WITH {PAIRS}, w AS (SELECT CAST(open_ts AS DATE) AS d, count(*) AS a, count(*) FILTER (WHERE duration_s > 600 AND duration_s < 86400) AS b, count(*) FILTER (WHERE duration_s > 600 AND duration_s < 86400 AND distance_m >= 1000) AS c FROM pairs GROUP BY ALL)
    SELECT d, 0 AS stage_index, 'duration' AS stage_name, a AS entered, b AS kept, a - b AS rejected FROM w UNION ALL SELECT d, 1, 'not short', b, c, b - c FROM w"""
)
def generic_funnel(spark: SparkSession, sf: str) -> DataFrame:
    t = trip_rows(spark, sf).groupBy(F.to_date("open_ts").alias("d")).agg(F.count("*").alias("a"), F.count_if("is_valid").alias("b"), F.count_if(F.col("is_valid") & (F.col("band") != "short")).alias("c"))
    return tracks.wide_funnel(t, [("duration", "a", "b"), ("not short", "b", "c")], ["d"])


def crossings(spark: SparkSession, sf: str) -> DataFrame:
    return grid.traverse(sessions(spark, sf).select(*KEY, "event_id", "x", "y"), KEY, "event_id", CELL)


# A leg is cut at grid lines; corners are crossed along x, then y; neighbouring stretches in a cell are merged.
CROSS = SESS + f""", legs AS (
  SELECT * FROM (SELECT user_id, s, row_number() OVER w AS leg, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1 FROM sess WINDOW w AS (PARTITION BY user_id, s ORDER BY event_id))
  WHERE x0 IS NOT NULL AND (x0 <> x1 OR y0 <> y1)
), cutlist AS (
  SELECT *, list_sort(list_distinct(list_filter(list_concat([CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)],
      CASE WHEN x0 <> x1 THEN list_transform(range(CAST(floor(least(x0, x1) / {CELL}) AS BIGINT) + 1, CAST(floor(greatest(x0, x1) / {CELL}) AS BIGINT) + 1), lambda k: (k * CAST({CELL} AS DOUBLE) - x0) / (x1 - x0)) ELSE CAST([] AS DOUBLE[]) END,
      CASE WHEN y0 <> y1 THEN list_transform(range(CAST(floor(least(y0, y1) / {CELL}) AS BIGINT) + 1, CAST(floor(greatest(y0, y1) / {CELL}) AS BIGINT) + 1), lambda k: (k * CAST({CELL} AS DOUBLE) - y0) / (y1 - y0)) ELSE CAST([] AS DOUBLE[]) END),
    lambda v: v >= 0 AND v <= 1))) AS cuts FROM legs
), parts0 AS (
  SELECT user_id, s, leg, x0, y0, x1, y1, cuts, unnest(range(1, len(cuts))) AS part FROM cutlist
), parts AS (
  SELECT user_id, s, leg, part, cuts[part] AS a, cuts[part + 1] AS b, x0, y0, x1, y1 FROM parts0 WHERE cuts[part + 1] - cuts[part] > 1e-12
), placed AS (
  SELECT user_id, s, leg, part, CAST(floor((x0 + (a + b) / 2 * (x1 - x0)) / {CELL}) AS INTEGER) AS cx, CAST(floor((y0 + (a + b) / 2 * (y1 - y0)) / {CELL}) AS INTEGER) AS cy,
         (b - a) * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, x0 + a * (x1 - x0) AS ex, y0 + a * (y1 - y0) AS ey, x0 + b * (x1 - x0) AS ox, y0 + b * (y1 - y0) AS oy FROM parts
), prev AS (
  SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM placed WINDOW w AS (PARTITION BY user_id, s ORDER BY leg, part)
), stepped AS (
  SELECT user_id, s, leg, part, 1000000 AS step, cx, cy, len, ex, ey, ox, oy FROM prev
  UNION ALL
  SELECT user_id, s, leg, part, i, CAST(px + sign(cx - px) * i AS INTEGER), py, 0.0, ex, ey, ex, ey FROM (SELECT *, unnest(range(1, abs(cx - px) + 1)) AS i FROM prev WHERE px IS NOT NULL) WHERE NOT (px + sign(cx - px) * i = cx AND py = cy)
  UNION ALL
  SELECT user_id, s, leg, part, 1000 + i, cx, CAST(py + sign(cy - py) * i AS INTEGER), 0.0, ex, ey, ex, ey FROM (SELECT *, unnest(range(1, abs(cy - py))) AS i FROM prev WHERE px IS NOT NULL)
), runs0 AS (
  SELECT *, CASE WHEN lag(cx) OVER w IS NULL OR lag(cx) OVER w <> cx OR lag(cy) OVER w <> cy THEN 1 ELSE 0 END AS new FROM stepped WINDOW w AS (PARTITION BY user_id, s ORDER BY leg, part, step)
), runs AS (
  SELECT *, CAST(sum(new) OVER (PARTITION BY user_id, s ORDER BY leg, part, step ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS run_index FROM runs0
), crossing AS (
  SELECT user_id, s, run_index, min(cx) AS cell_x, min(cy) AS cell_y, sum(len) AS length_m, first(ex ORDER BY leg, part, step) AS entry_x, first(ey ORDER BY leg, part, step) AS entry_y, last(ox ORDER BY leg, part, step) AS exit_x, last(oy ORDER BY leg, part, step) AS exit_y FROM runs GROUP BY ALL)"""


@query(f"WITH {CROSS} SELECT user_id, s, run_index, cell_x, cell_y, round(length_m, 4) AS length_m FROM crossing")
def grid_traverse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crossings(spark, sf).select(*KEY, "run_index", "cell_x", "cell_y", "length_m"), 4)


LINKS = CROSS + """, first_day AS (SELECT user_id, s, min(d) AS d FROM sess GROUP BY ALL
), moves AS (
  SELECT DISTINCT d, user_id, s, from_x, from_y, to_x, to_y FROM (
    SELECT user_id, s, lag(cell_x) OVER w AS from_x, lag(cell_y) OVER w AS from_y, cell_x AS to_x, cell_y AS to_y FROM crossing WINDOW w AS (PARTITION BY user_id, s ORDER BY run_index)) JOIN first_day USING (user_id, s)
  WHERE from_x IS NOT NULL
), links AS (SELECT d, from_x, from_y, to_x, to_y, count(*) AS tracks FROM moves GROUP BY ALL)"""


def link_rows(spark: SparkSession, sf: str) -> DataFrame:
    # The day of a session is part of its key from the start: sessions are already together by user, so no further shuffle or join.
    points = sessions(spark, sf).select(*KEY, "event_id", "x", "y", F.min("d").over(Window.partitionBy(*KEY)).alias("d"))
    return grid.cell_links(grid.traverse(points, ["d", *KEY], "event_id", CELL), "d", KEY)


@query(f"WITH {LINKS} SELECT * FROM links")
def cell_links(spark: SparkSession, sf: str) -> DataFrame:
    return link_rows(spark, sf)


@query(f"WITH {LINKS} SELECT from_x AS cell_x, from_y AS cell_y FROM links UNION SELECT to_x, to_y FROM links")
def linked_cells(spark: SparkSession, sf: str) -> DataFrame:
    return grid.linked_cells(link_rows(spark, sf))


@query(
    f"""WITH {LINKS}, c AS (SELECT DISTINCT cell_x, cell_y, cell_x // 2 AS region FROM (SELECT from_x AS cell_x, from_y AS cell_y FROM links UNION SELECT to_x, to_y FROM links))
    SELECT DISTINCT least(a.region, b.region) AS a, greatest(a.region, b.region) AS b FROM c a JOIN c b ON (b.cell_x = a.cell_x + 1 AND b.cell_y = a.cell_y) OR (b.cell_x = a.cell_x AND b.cell_y = a.cell_y + 1) WHERE a.region <> b.region"""
)
def rook_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    cells = grid.linked_cells(link_rows(spark, sf)).withColumn("region", F.floor(F.col("cell_x") / 2).cast("int"))
    return grid.region_adjacency(cells, "region")


@query(
    f"""WITH {LINKS}, g AS (SELECT from_x, from_y, to_x, to_y, CAST(sum(tracks) AS BIGINT) AS tracks FROM links GROUP BY ALL)
    SELECT from_x, from_y, to_x, to_y, tracks, CAST(max(tracks) OVER () AS BIGINT) AS most FROM g WHERE tracks > 1"""
)
def shared_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = link_rows(spark, sf).groupBy("from_x", "from_y", "to_x", "to_y").agg(F.sum("tracks").alias("tracks")).where("tracks > 1")
    return g.crossJoin(F.broadcast(g.agg(F.max("tracks").alias("most"))))


REACH = MatchParams().radius_m


@query(
    f"""WITH {E}, p AS (SELECT event_id, x, y FROM e), n AS (
      SELECT a.event_id, b.event_id AS near_event_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance_m FROM p a JOIN p b ON a.event_id <> b.event_id AND abs(a.x - b.x) <= {REACH} AND abs(a.y - b.y) <= {REACH}), r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY distance_m, near_event_id) AS INTEGER) AS rank FROM n WHERE distance_m <= {REACH})
    SELECT event_id, near_event_id, round(distance_m, 6) AS distance_m, rank FROM r WHERE rank <= {MatchParams().candidates}"""
)
def knn_radius(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest neighbours of every event within the matcher's radius, which reaches across rows of points."""
    p = events(spark, sf).select("event_id", "x", "y")
    return rounded(spatial.knn_within(p, p, "event_id", "event_id", REACH, MatchParams().candidates))


ANCHORS = [(5 * i + j, 1000.0 * i, 750.0 * j) for i in range(5) for j in range(5)]


@query(
    f"""WITH {E}, a(id, ax, ay) AS (VALUES {", ".join(map(str, ANCHORS))})
    SELECT event_id, CAST(min_by(id, (x - ax) * (x - ax) + (y - ay) * (y - ay) + id * 1e-9) AS INTEGER) AS anchor FROM e, a GROUP BY event_id"""
)
def nearest_tiebreak(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select("event_id", spatial.nearest_anchor(e, ANCHORS)["id"].cast("int").alias("anchor"))


REGION_CELLS = """region_cells AS (SELECT CAST(i AS INTEGER) AS cell_x, CAST(j AS INTEGER) AS cell_y, CAST(i // 3 * 10 + j // 2 AS INTEGER) AS region FROM range(0, 9) a(i), range(0, 5) b(j) WHERE (i + j) % 4 <> 0)"""


def region_cells(spark: SparkSession) -> DataFrame:
    g = spark.range(9).select(F.col("id").cast("int").alias("cell_x")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("cell_y")))
    return g.where((F.col("cell_x") + F.col("cell_y")) % 4 != 0).withColumn("region", (F.floor(F.col("cell_x") / 3) * 10 + F.floor(F.col("cell_y") / 2)).cast("int"))


@query(
    f"""WITH {E}, {REGION_CELLS}, hit AS (
      SELECT event_id, x, y, region FROM e LEFT JOIN region_cells ON CAST(floor(x / {CELL}) AS INTEGER) = cell_x AND CAST(floor(y / {CELL}) AS INTEGER) = cell_y
    ), away AS (
      SELECT event_id, r.region, sqrt(power(greatest(abs(x - (cell_x + 0.5) * {CELL}) - {CELL} / 2, 0), 2) + power(greatest(abs(y - (cell_y + 0.5) * {CELL}) - {CELL} / 2, 0), 2)) AS d FROM hit h, region_cells r WHERE h.region IS NULL
    ), near AS (SELECT event_id, min(region) AS region FROM (SELECT *, min(d) OVER (PARTITION BY event_id) AS least FROM away) WHERE d <= least + 1e-9 GROUP BY event_id)
    SELECT event_id, region, FALSE AS is_fallback FROM hit WHERE region IS NOT NULL UNION ALL SELECT event_id, region, TRUE FROM near"""
)
def cell_assign(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.lookup_or_nearest(events(spark, sf).select("event_id", "x", "y"), region_cells(spark), CELL, "event_id")


@query(
    f"""WITH {SESS}, m AS (SELECT user_id, s, event_id, coalesce(sum(step_m) OVER (PARTITION BY user_id, s ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0.0) AS pos FROM sess
    ), total AS (SELECT user_id, s, max(pos) AS total FROM m GROUP BY ALL
    ), spans AS (SELECT user_id, s, i, total * i / 4.0 AS a, CASE WHEN i = 3 THEN total ELSE total * (i + 1) / 4.0 END AS b, i = 3 AS is_last FROM total, range(0, 4) r(i))
    SELECT m.user_id, m.s, CAST(i AS INTEGER) AS i, count(*) AS points FROM m JOIN spans ON m.user_id = spans.user_id AND m.s = spans.s AND pos >= a AND (pos < b OR (is_last AND pos <= b)) GROUP BY ALL"""
)
def interval_count(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    m = sessions(spark, sf).select(*KEY, "event_id", F.coalesce(F.sum("step_m").over(w), F.lit(0.0)).alias("at"))
    total = m.groupBy(*KEY).agg(F.max("at").alias("total"))
    spans = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(*KEY, "i", (F.col("total") * F.col("i") / 4.0).alias("a"), F.when(F.col("i") == 3, F.col("total")).otherwise(F.col("total") * (F.col("i") + 1) / 4.0).alias("b"), (F.col("i") == 3).alias("is_last"))
    return spatial.in_interval(m, spans, KEY, "at", "a", "b", "is_last", 2000.0).groupBy(*KEY, "i").agg(F.count("*").alias("points"))


VISIT = SESS + """, visit AS (
  SELECT user_id, s, event_id, ts, d, CAST(k // 20 AS INTEGER) AS region, x, y, gap_s > 10800 AS gap FROM sess)"""


def visit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select(*KEY, "event_id", "ts", "d", F.floor(F.col("k") / 20).cast("int").alias("region"), "x", "y", (F.col("gap_s") > 10800).alias("gap"))


@query(
    f"""WITH {VISIT}, m AS (SELECT *, lag(region) OVER (PARTITION BY user_id, s ORDER BY event_id) AS from_region FROM visit
    ), c AS (SELECT DISTINCT d, user_id, s, from_region, region AS to_region FROM m WHERE from_region IS NOT NULL AND from_region <> region AND NOT coalesce(gap, FALSE))
    SELECT d, from_region, to_region, count(*) AS tracks FROM c GROUP BY ALL"""
)
def flow_channel(spark: SparkSession, sf: str) -> DataFrame:
    moves = profiles.transitions(visit_rows(spark, sf), KEY, "event_id", F.coalesce("gap", F.lit(False)))
    return profiles.flow_channel(moves, ["d"], KEY)


@query(f"WITH {VISIT}, t AS (SELECT user_id, s, first(d ORDER BY event_id) AS d, first(region ORDER BY event_id) AS from_region, last(region ORDER BY event_id) AS to_region FROM visit GROUP BY ALL) SELECT d, from_region, to_region, count(*) AS tracks FROM t GROUP BY ALL")
def flow_track_od(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.flow_track_od(visit_rows(spark, sf), KEY, "event_id", ["d"])


@query(
    f"""WITH {PAIRS} SELECT CAST(hour(open_ts) AS INTEGER) AS hour, CAST(floor(open_x / 1000) AS INTEGER) AS from_region, CAST(floor(close_x / 1000) AS INTEGER) AS to_region, count(*) AS trips FROM pairs GROUP BY ALL"""
)
def flow_od(spark: SparkSession, sf: str) -> DataFrame:
    t = trip_rows(spark, sf).select(F.hour("open_ts").alias("hour"), F.floor(F.col("open_x") / 1000).cast("int").alias("a"), F.floor(F.col("close_x") / 1000).cast("int").alias("b"))
    return profiles.flow_od(t, ["hour"], "a", "b")


VOTES = VISIT + """, ends AS (SELECT user_id, s, first(region ORDER BY event_id) AS a, last(region ORDER BY event_id) AS z FROM visit GROUP BY ALL
), per AS (SELECT user_id, s, region, last(x ORDER BY event_id) - first(x ORDER BY event_id) AS dx, last(y ORDER BY event_id) - first(y ORDER BY event_id) AS dy FROM visit GROUP BY ALL
), votes0 AS (SELECT per.*, region <> a AND region <> z AS is_transit, sqrt(dx * dx + dy * dy) AS len FROM per JOIN ends USING (user_id, s)
), votes AS (SELECT *, is_transit AND len >= 1.0 AS counts FROM votes0)"""


def vote_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = visit_rows(spark, sf).withColumns({"entry_x": F.col("x"), "entry_y": F.col("y"), "exit_x": F.col("x"), "exit_y": F.col("y")})
    return profiles.transit_votes(v, KEY, ["event_id"])


BEARING = "(degrees(atan2(dx, dy)) + 360.0) % 360.0"


@query(f"WITH {VOTES} SELECT user_id, s, region, is_transit, round(dx, 6) AS dx, round(dy, 6) AS dy, CASE WHEN counts THEN CAST(floor({BEARING} / 22.5 + 0.5) AS INTEGER) % 16 END AS sector FROM votes")
def transit_votes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vote_rows(spark, sf).select(*KEY, "region", "is_transit", "dx", "dy", "sector"))


@query(
    f"""WITH {VOTES}, t AS (SELECT region, is_transit, counts, CASE WHEN counts THEN CAST(floor({BEARING} / 22.5 + 0.5) AS INTEGER) % 16 END AS sector, CASE WHEN counts THEN dy / len END AS c, CASE WHEN counts THEN dx / len END AS s1 FROM votes
    ), a AS (SELECT region, count(*) AS visiting, count(*) FILTER (WHERE is_transit) AS transit, count(sector) AS chords, coalesce(sum(c), 0) AS c1, coalesce(sum(s1), 0) AS n1, coalesce(sum(c * c - s1 * s1), 0) AS c2, coalesce(sum(2 * s1 * c), 0) AS n2,
      {", ".join(f"count(*) FILTER (WHERE sector = {i}) AS sector_{i:02d}" for i in range(16))} FROM t GROUP BY region)
    SELECT region, visiting, CAST(transit AS BIGINT) AS transit, chords, {", ".join(f"sector_{i:02d}" for i in range(16))}, round(CASE WHEN visiting > 0 THEN transit / visiting END, 6) AS transit_rate,
      round(CASE WHEN chords > 0 THEN least(1.0, sqrt(c1 * c1 + n1 * n1) / chords) END, 6) AS r, round(CASE WHEN chords > 0 THEN least(1.0, sqrt(c2 * c2 + n2 * n2) / chords) END, 6) AS r_axial,
      round(CASE WHEN sqrt(c1 * c1 + n1 * n1) > 1e-12 THEN (degrees(atan2(n1, c1)) + 360.0) % 360.0 END, 4) AS mean_bearing, round(CASE WHEN sqrt(c2 * c2 + n2 * n2) > 1e-12 THEN (degrees(atan2(n2, c2)) / 2 + 180.0) % 180.0 END, 4) AS axis_bearing FROM a"""
)
def circular_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = profiles.circular(vote_rows(spark, sf), ["region"])
    return rounded(c.drop("sum_cos1", "sum_sin1", "sum_cos2", "sum_sin2"), mean_bearing=4, axis_bearing=4)


@query(
    f"""WITH {VOTES}, st AS (SELECT user_id, s, min(t) AS t0 FROM sess GROUP BY ALL), g AS (
      SELECT region, count(*) AS visiting, count(*) FILTER (WHERE is_transit) AS transit FROM votes JOIN st USING (user_id, s) WHERE t0 % 86400 BETWEEN 25200 AND 61200 GROUP BY region)
    SELECT CAST(r.region AS INTEGER) AS region, coalesce(visiting, 0) AS visiting, coalesce(transit, 0) AS transit, round(CASE WHEN visiting > 0 THEN transit / visiting END, 6) AS rate FROM range(0, 5) r(region) LEFT JOIN g ON g.region = r.region"""
)
def core_rate(spark: SparkSession, sf: str) -> DataFrame:
    v = visit_rows(spark, sf).withColumns({"t0": F.min("ts").over(Window.partitionBy(*KEY)), "entry_x": F.col("x"), "entry_y": F.col("y"), "exit_x": F.col("x"), "exit_y": F.col("y")})
    votes = profiles.transit_votes(v.where(second_of_day(F.col("t0")).between(25200, 61200)), KEY, ["event_id"])
    g = votes.groupBy("region").agg(F.count("*").alias("visiting"), F.count_if("is_transit").alias("transit"))
    base = spark.range(5).select(F.col("id").cast("int").alias("region"))
    d = profiles.dense(base, [g], ["region"], ["visiting", "transit"])
    return rounded(d.select("region", "visiting", "transit", F.when(F.col("visiting") > 0, F.col("transit") / F.col("visiting")).alias("rate")))


@query(
    f"""WITH {ROLL}, p AS (SELECT CAST(points AS DOUBLE) AS points, CAST(duration_s AS DOUBLE) AS duration_s FROM valid)
    SELECT count(*) AS sessions, round(quantile_cont(duration_s, 0.5), 4) AS median_s, round(quantile_cont(duration_s, 0.9), 4) AS p90_s, round(quantile_cont(duration_s, 0.95), 4) AS p95_s, round(sqrt(quantile_cont(points, 0.5)) * {CELL}, 4) AS width_m FROM p"""
)
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    t = sessions(spark, sf).groupBy(*KEY).agg(F.count("*").alias("points"), (seconds(F.max("ts")) - seconds(F.min("ts"))).alias("duration_s"))
    q = F.percentile("duration_s", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    a = t.agg(F.count("*").alias("sessions"), q.alias("q"), (F.sqrt(F.percentile("points", F.lit(0.5))) * CELL).alias("width_m"))
    return rounded(a.select("sessions", F.col("q")[0].alias("median_s"), F.col("q")[1].alias("p90_s"), F.col("q")[2].alias("p95_s"), "width_m"), 4)


LONGEST = SequenceParams().max_length
SEQ = VISIT + f""", cut AS (SELECT *, sum(CASE WHEN rn = 1 THEN 0 WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, s ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seg
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY event_id) AS rn FROM visit)
), seqs AS (SELECT user_id, s, CAST(seg AS INTEGER) AS segment_index, list(region ORDER BY event_id) AS regions, min(d) AS d FROM cut GROUP BY ALL HAVING count(*) >= 2
), runs AS (SELECT DISTINCT user_id, s, segment_index, d, regions[i:i + n - 1] AS pattern FROM (SELECT *, unnest(range(2, least({LONGEST}, len(regions) - i + 1) + 1)) AS n FROM (SELECT *, unnest(range(1, len(regions))) AS i FROM seqs)))"""


def sequence_rows(spark: SparkSession, sf: str) -> DataFrame:
    v = visit_rows(spark, sf).withColumn("gap", F.coalesce("gap", F.lit(False)))
    return sequences.cut_sequences(v, ["user_id"], "s", "event_id", "region", "gap")


@query(f"WITH {SEQ} SELECT user_id, s, segment_index, array_to_string(regions, '-') AS regions, CAST(len(regions) AS INTEGER) AS length FROM seqs")
def sequence_cut(spark: SparkSession, sf: str) -> DataFrame:
    return sequence_rows(spark, sf).select(*KEY, "segment_index", F.array_join(F.transform("regions", lambda r: r.cast("string")), "-").alias("regions"), "length")


def support_rows(spark: SparkSession, sf: str, max_length: int = LONGEST) -> DataFrame:
    return sequences.contiguous_patterns(sequence_rows(spark, sf), KEY, max_length).groupBy("pattern").agg(F.count("*").alias("support"))


def text(pattern="pattern"):
    return F.array_join(F.transform(pattern, lambda r: r.cast("string")), "-")


SUPPORT = SEQ + ", supp AS (SELECT pattern, count(*) AS support FROM runs GROUP BY pattern)"


@query(f"WITH {SUPPORT} SELECT array_to_string(pattern, '-') AS pattern, support FROM supp")
def contiguous_support(spark: SparkSession, sf: str) -> DataFrame:
    return support_rows(spark, sf).select(text().alias("pattern"), "support")


@query(f"WITH {SUPPORT} SELECT array_to_string(pattern, '-') AS pattern, support FROM supp WHERE support >= 3 ORDER BY support DESC, pattern LIMIT 40")
def pattern_top(spark: SparkSession, sf: str) -> DataFrame:
    return support_rows(spark, sf).where("support >= 3").orderBy(F.desc("support"), "pattern").limit(40).select(text().alias("pattern"), "support")


RUNGS = (2, 3, 5, 10, 20, 50)


@query(f"WITH {SUPPORT}, r(rung) AS (VALUES {', '.join(f'({r})' for r in RUNGS)}) SELECT CAST(rung AS BIGINT) AS rung, CAST(len(pattern) AS INTEGER) AS length, count(*) AS patterns, max(support) AS top_support FROM supp JOIN r ON support >= rung GROUP BY ALL")
def support_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.support_scan(support_rows(spark, sf), RUNGS)


def overlap_rows(spark: SparkSession, sf: str, max_length: int = LONGEST) -> DataFrame:
    from ..operators.stats import coverage, jaccard

    v = visit_rows(spark, sf).withColumn("gap", F.coalesce("gap", F.lit(False))).withColumnRenamed("d", "day")
    w = Window.partitionBy(*KEY, "segment_index")
    cut = v.withColumn("segment_index", F.sum(F.when(F.row_number().over(Window.partitionBy(*KEY).orderBy("event_id")) == 1, 0).otherwise(F.col("gap").cast("int"))).over(Window.partitionBy(*KEY).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    days = cut.withColumn("d", F.min("day").over(w)).select(*KEY, "segment_index", "d").distinct()
    seqs = sequences.cut_sequences(v, ["user_id"], "s", "event_id", "region", "gap").join(days, [*KEY, "segment_index"])
    p = sequences.contiguous_patterns(seqs, [*KEY, "d"], max_length).withColumn("even", F.dayofmonth("d") % 2 == 0)
    per = p.groupBy("pattern").agg((F.count_if("even") >= 2).alias("a"), (F.count_if(~F.col("even")) >= 2).alias("b")).where("a or b")
    return rounded(per.agg(F.count("*").alias("patterns"), jaccard(F.col("a"), F.col("b")).alias("jaccard"), coverage(F.col("a"), F.col("b")).alias("covered")))


@query(
    f"""WITH {SEQ}, sc AS (SELECT CASE WHEN dayofmonth(d) % 2 = 0 THEN 'even' ELSE 'odd' END AS scope, pattern, count(*) AS support FROM runs GROUP BY ALL
    ), j AS (SELECT a.pattern IS NOT NULL AS a, b.pattern IS NOT NULL AS b FROM (SELECT * FROM sc WHERE scope = 'even' AND support >= 2) a FULL JOIN (SELECT * FROM sc WHERE scope = 'odd' AND support >= 2) b ON a.pattern = b.pattern)
    SELECT count(*) AS patterns, round(count(*) FILTER (WHERE a AND b) / count(*), 6) AS jaccard, round(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a), 0), 6) AS covered FROM j"""
)
def pattern_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_rows(spark, sf)


@query(
    f"""WITH {SESS}, n AS (SELECT *, CAST(floor(x / {CELL}) AS INTEGER) AS c, lag(CAST(floor(x / {CELL}) AS INTEGER)) OVER w AS pc, row_number() OVER w AS rn FROM sess WINDOW w AS (PARTITION BY user_id, s ORDER BY event_id)
    ), i AS (SELECT *, sum(CASE WHEN rn = 1 THEN 1 WHEN pc = c THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, s ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS run_index FROM n
    ), g AS (SELECT user_id, s, run_index, c, count(*) AS rows, sum(value) AS weight FROM i GROUP BY ALL)
    SELECT user_id, s, CAST(run_index AS BIGINT) AS run_index, c, "rows", round(weight, 4) AS weight, round(coalesce(sum(weight) OVER (PARTITION BY user_id, s ORDER BY run_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS before FROM g"""
)
def islands(spark: SparkSession, sf: str) -> DataFrame:
    c = sessions(spark, sf).withColumn("c", F.floor(F.col("x") / CELL).cast("int"))
    return rounded(tracks.islands(c, KEY, "event_id", ["c"], "value"), 4)


@query(
    f"""WITH {E}, sizes(size) AS (VALUES (150.0), (300.0), (600.0)), c AS (SELECT size, floor(x / size) AS cx, floor(y / size) AS cy, count(*) AS n FROM e, sizes GROUP BY ALL)
    SELECT CAST(size AS DOUBLE) AS size, count(*) AS cells, max(n) AS most, CAST(CASE size WHEN 150 THEN 14 WHEN 300 THEN 4 ELSE 1 END AS INTEGER) AS floor_cells FROM c GROUP BY size"""
)
def cells_floor(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    sized = e.withColumn("size", F.explode(F.array(F.lit(150.0), F.lit(300.0), F.lit(600.0))))
    c = sized.groupBy("size", F.floor(F.col("x") / F.col("size")).alias("cx"), F.floor(F.col("y") / F.col("size")).alias("cy")).agg(F.count("*").alias("n"))
    floor = F.create_map(*[v for s in (150.0, 300.0, 600.0) for v in (F.lit(s), F.lit(grid.min_cells(s)))])
    return c.groupBy("size").agg(F.count("*").alias("cells"), F.max("n").alias("most")).withColumn("floor_cells", floor[F.col("size")].cast("int"))


@query(
    f"""WITH {PAIRS}, ev AS (SELECT CAST(hour(open_ts) AS INTEGER) AS h, CAST(floor(open_x / 1000) AS INTEGER) AS region, -1 AS v FROM pairs UNION ALL SELECT CAST(hour(close_ts) AS INTEGER), CAST(floor(close_x / 1000) AS INTEGER), 1 FROM pairs
    ), g AS (SELECT region, h // 6 AS q, sum(v) AS net FROM ev GROUP BY ALL)
    SELECT region, {", ".join(f"CAST(coalesce(sum(net) FILTER (WHERE q = {i}), 0) AS BIGINT) AS q{i}" for i in range(4))},
      CAST({" + ".join(f"CASE WHEN sign(coalesce(sum(net) FILTER (WHERE q = {i}), 0)) <> sign(coalesce(sum(net) FILTER (WHERE q = {i + 1}), 0)) THEN 1 ELSE 0 END" for i in range(3))} AS INTEGER) AS sign_changes FROM g GROUP BY region"""
)
def pivot_hours(spark: SparkSession, sf: str) -> DataFrame:
    t = trip_rows(spark, sf)
    both = t.select(F.explode(F.array(F.struct(F.hour("open_ts").alias("h"), F.floor(F.col("open_x") / 1000).cast("int").alias("region"), F.lit(-1).alias("v")), F.struct(F.hour("close_ts").alias("h"), F.floor(F.col("close_x") / 1000).cast("int").alias("region"), F.lit(1).alias("v")))).alias("e")).select("e.*")
    p = both.withColumn("q", F.floor(F.col("h") / 6)).groupBy("region").pivot("q", [0, 1, 2, 3]).agg(F.sum("v")).fillna(0)
    p = p.select("region", *[F.col(str(i)).cast("long").alias(f"q{i}") for i in range(4)])
    changes = sum(((F.signum(f"q{i}") != F.signum(f"q{i + 1}")).cast("int") for i in range(3)), F.lit(0))
    return p.withColumn("sign_changes", changes)


@query(
    f"""WITH {E}, seen AS (SELECT user_id, d, count(*) AS n, count(DISTINCT event_type) AS kinds FROM e GROUP BY ALL), sc AS (SELECT d, 'all' AS scope FROM (SELECT DISTINCT d FROM e) UNION ALL SELECT d, CAST(d AS VARCHAR) FROM (SELECT DISTINCT d FROM e WHERE dayofmonth(d) <= 5))
    SELECT scope, CAST(sum(n) AS BIGINT) AS events, CAST(sum(kinds) AS BIGINT) AS kinds, count(DISTINCT user_id) AS users FROM seen JOIN sc USING (d) GROUP BY scope"""
)
def scope_fanout(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    seen = e.groupBy("user_id", "d").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    days = e.select("d").distinct()
    scopes = days.withColumn("scope", F.lit("all")).union(days.where(F.dayofmonth("d") <= 5).withColumn("scope", F.col("d").cast("string")))
    return sequences.fan_out(seen, "d", scopes).groupBy("scope").agg(F.sum("n").alias("events"), F.sum("kinds").alias("kinds"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {E} SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds, CAST(count(*) AS INTEGER) AS n FROM e GROUP BY user_id")
def ordered_collect(spark: SparkSession, sf: str) -> DataFrame:
    g = events(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("a"))
    return g.select("user_id", F.array_join(F.transform("a", lambda s: s["event_type"]), ",").alias("kinds"), F.size("a").alias("n"))


