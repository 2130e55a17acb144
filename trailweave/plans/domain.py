"""Queries of operators that SQL cannot express; tests hold them against plain versions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import community, grid, matching, profiles, sequences, serving, trajectory, visits
from ..params import CommunityParams, DebounceParams, MatchParams, SequenceParams
from .base import CELL, SESS, SPLIT, query, rounded, sessions, walks
from .tracks import CROSS, KEY, SEQ, SUPPORT, crossings, link_rows, sequence_rows


@query(
    f"""WITH RECURSIVE {SEQ}, ids AS (SELECT row_number() OVER () AS id, regions FROM seqs
    ), sub(id, spot, pattern) AS (SELECT id, i, [regions[i]] FROM (SELECT id, regions, unnest(range(1, len(regions) + 1)) AS i FROM ids)
      UNION SELECT s.id, j, list_append(s.pattern, regions[j]) FROM (SELECT sub.*, regions, unnest(range(spot + 1, len(regions) + 1)) AS j FROM sub JOIN ids USING (id) WHERE len(pattern) < {SequenceParams().max_length}) s
    ), held AS (SELECT DISTINCT id, pattern FROM sub WHERE len(pattern) >= 2), n AS (SELECT count(*) AS n FROM ids)
    SELECT array_to_string(pattern, '-') AS pattern, count(*) AS support FROM held GROUP BY pattern HAVING count(*) >= (SELECT greatest(floor(0.02 * n + 0.5), 5) FROM n)"""
)
def prefixspan(spark: SparkSession, sf: str) -> DataFrame:
    p = SequenceParams(support_ratio=0.02, support_floor=5)
    seqs = sequence_rows(spark, sf)
    least = sequences.support_threshold(seqs.count(), p) or p.support_floor
    found = sequences.mine(seqs, least, p)
    return found.select(F.array_join(F.transform("pattern", lambda r: r.cast("string")), "-").alias("pattern"), "support").orderBy(F.length("pattern"), F.desc("support"), "pattern")


@query(
    f"""WITH {SUPPORT}, pats AS (SELECT pattern, support AS contiguous FROM supp), step(pattern, k, i, contiguous, user_id, s, segment_index, regions) AS (
      SELECT pattern, 0, 0, contiguous, user_id, s, segment_index, regions FROM pats, seqs),
    walk AS (SELECT pattern, contiguous, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(regions, lambda r: CAST(r AS BIGINT))), lambda k, r: CASE WHEN k < len(pattern) AND pattern[k + 1] = r THEN k + 1 ELSE k END) AS k FROM step)
    SELECT array_to_string(pattern, '-') AS pattern, CAST(count(*) FILTER (WHERE k = len(pattern)) AS BIGINT) AS support, contiguous FROM walk GROUP BY ALL"""
)
def contained_support(spark: SparkSession, sf: str) -> DataFrame:
    """Gapped support of every run."""
    seqs = sequence_rows(spark, sf)
    runs = sequences.contiguous_patterns(seqs, KEY, SequenceParams().max_length).select("pattern").distinct()
    got = sequences.contained_support(seqs, runs)
    return got.select(F.array_join(F.transform("pattern", lambda r: r.cast("string")), "-").alias("pattern"), "support", "contiguous")


LEAST = 700.0

# Spans of one region and their points, then what the spans before say, all in windows over a piece.
VISITS = CROSS + f""", placed_cells AS (SELECT *, CASE WHEN cell_y < 4 THEN cell_x // 2 END AS region FROM crossing
), span_starts AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND region IS DISTINCT FROM lag(region) OVER w THEN 1 ELSE 0 END AS new FROM placed_cells WINDOW w AS (PARTITION BY user_id, s ORDER BY run_index)
), span_numbers AS (SELECT *, sum(new) OVER w AS span, sum(length_m) OVER w AS until FROM span_starts WINDOW w AS (PARTITION BY user_id, s ORDER BY run_index ROWS UNBOUNDED PRECEDING)
), merged AS (SELECT user_id, s, span, first(region) AS region, sum(length_m) AS length_m, max(until) AS end_m, first(entry_x ORDER BY run_index) AS entry_x, first(entry_y ORDER BY run_index) AS entry_y, last(exit_x ORDER BY run_index) AS exit_x, last(exit_y ORDER BY run_index) AS exit_y FROM span_numbers GROUP BY user_id, s, span
), bounds AS (SELECT *, coalesce(lag(end_m) OVER (PARTITION BY user_id, s ORDER BY span), 0.0) AS start_m, max(end_m) OVER (PARTITION BY user_id, s) AS total FROM merged
), counted AS (SELECT b.*, (SELECT count(*) FROM sess o WHERE o.user_id = b.user_id AND o.s = b.s AND o.value >= b.start_m AND (o.value < b.end_m OR b.end_m >= b.total - 1e-9)) AS points FROM bounds b
), kinds AS (SELECT *, length_m >= {LEAST} OR points >= 2 AS is_long, CASE WHEN length_m >= {LEAST} OR points >= 2 THEN coalesce(region, -1) END AS mark FROM counted
), lasts AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id, s ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kinds
), parts_of_visits AS (
  SELECT *, sum(CASE WHEN is_long AND region IS NOT NULL AND before IS DISTINCT FROM region THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, s ORDER BY span ROWS UNBOUNDED PRECEDING) - 1 AS visit_index,
         (is_long AND region IS NOT NULL) OR (NOT is_long AND before >= 0) AS is_part FROM lasts
), visit_rows AS (
  SELECT user_id, s, CAST(visit_index AS INTEGER) AS visit_index, first(region ORDER BY span) AS region, sum(length_m) AS length_m, first(entry_x ORDER BY span) AS entry_x, first(entry_y ORDER BY span) AS entry_y, last(exit_x ORDER BY span) AS exit_x, last(exit_y ORDER BY span) AS exit_y, coalesce(first(before ORDER BY span) = -1, FALSE) AS gap_before
  FROM parts_of_visits WHERE is_part GROUP BY user_id, s, visit_index)"""


@query(
    f"""WITH {VISITS} SELECT user_id, s, visit_index, CAST(region AS INTEGER) AS region, round(length_m, 6) AS length_m, round(entry_x, 6) AS entry_x, round(entry_y, 6) AS entry_y, round(exit_x, 6) AS exit_x, round(exit_y, 6) AS exit_y, gap_before FROM visit_rows"""
)
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    c = crossings(spark, sf).withColumn("region", F.when(F.col("cell_y") < 4, F.floor(F.col("cell_x") / 2)).cast("int"))
    offsets = sessions(spark, sf).select(*KEY, F.col("value").alias("offset_m"))
    return rounded(visits.debounce_pieces(c, offsets, KEY, DebounceParams(min_length_m=LEAST)))


def street_grid(columns: int = 10, rows: int = 6, step: float = 500.0) -> list[tuple]:
    """Streets along the lines of a square grid; every fifth is one-way."""
    node = lambda i, j: i * 1000 + j
    ways = [((i, j), (i + 1, j)) for i in range(columns) for j in range(rows + 1)] + [((i, j), (i, j + 1)) for i in range(columns + 1) for j in range(rows)]
    return [(k, node(*a), node(*b), [(a[0] * step, a[1] * step), (b[0] * step, b[1] * step)], True, k % 5 != 0) for k, (a, b) in enumerate(ways)]


WIDE = MatchParams(radius_m=250.0, cutoff_m=2000.0, sigma_m=100.0, beta_m=400.0)


@query()
def map_match(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the events, which are short and wide apart, on wide streets."""
    return rounded(matching.match_tracks(sessions(spark, sf).select(*KEY, "event_id", "x", "y"), street_grid(), WIDE, KEY, "event_id"), 4)


@query()
def match_quality(spark: SparkSession, sf: str) -> DataFrame:
    streets = street_grid()
    points, _, pieces = matching.match_tables(sessions(spark, sf).select(*KEY, "event_id", "x", "y"), streets, WIDE, KEY, "event_id")
    legal = spark.createDataFrame([(2 * k + d, ok) for k, _, _, _, *ways in streets for d, ok in enumerate(ways)], "edge long, is_legal_direction boolean")
    return rounded(matching.judge_matches(points, pieces, KEY, "event_id", WIDE, legal), 4)


BLOCKS = {"columns": 34, "rows": 20, "step": 150.0}


@query()
def walk_match(spark: SparkSession, sf: str) -> DataFrame:
    """Long tracks on a dense street grid, with the parameters of a city."""
    return rounded(matching.match_tracks(walks(spark, sf), street_grid(**BLOCKS), MatchParams(), ["user_id"], "event_id"), 4)


@query()
def walk_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of an edge that a track rides over, observed or inferred, and how many tracks do."""
    _, edges, _ = matching.match_tables(walks(spark, sf), street_grid(**BLOCKS), MatchParams(), ["user_id"], "event_id")
    return rounded(edges.groupBy("edge", "is_inferred").agg(F.count_distinct("user_id").alias("tracks"), F.sum(F.col("end_m") - F.col("start_m")).alias("length_m")), 4)


def walk_pieces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(visits, transit votes) of long tracks: matched, laid over the grid, given regions of four by four cells without every seventh, debounced."""
    points, _, pieces = matching.match_tables(walks(spark, sf), street_grid(**BLOCKS), MatchParams(), ["user_id"], "event_id")
    piece = ["user_id", "piece"]
    cells = grid.traverse(matching.piece_points(pieces, ["user_id"]), piece, "seq", 150.0)
    region = (F.floor(F.col("cell_x") / 4) * 100 + F.floor(F.col("cell_y") / 4)).cast("int")
    cells = cells.withColumn("region", F.when((F.col("cell_x") + 3 * F.col("cell_y")) % 7 != 0, region))
    offsets = points.where("piece is not null").select(*piece, "offset_m")
    found = visits.debounce_pieces(cells, offsets, piece, DebounceParams())
    return found, profiles.transit_votes(found, ["user_id"], ["piece", "visit_index"])


@query()
def walk_visits(spark: SparkSession, sf: str) -> DataFrame:
    """From points to visits: match, grid, regions, debounce."""
    return rounded(walk_pieces(spark, sf)[0], 4)


@query()
def walk_profile(spark: SparkSession, sf: str) -> DataFrame:
    """From points to directional statistics of regions."""
    return rounded(profiles.circular(walk_pieces(spark, sf)[1], ["region"]).drop("sum_cos1", "sum_sin1", "sum_cos2", "sum_sin2"), 4)


#: Links of a map that may be gathered for community search; a larger map has to be cut first.
MAX_LINKS = 2_000_000


def _network(spark: SparkSession, sf: str) -> list[tuple]:
    """Links between cells, summed over days: as many as the map has neighbouring cells."""
    g = link_rows(spark, sf).groupBy("from_x", "from_y", "to_x", "to_y").agg(F.sum("tracks").alias("n"))
    rows = g.orderBy("from_x", "from_y", "to_x", "to_y").limit(MAX_LINKS + 1).collect()
    if len(rows) > MAX_LINKS:
        raise ValueError(f"more than {MAX_LINKS} links: cut the map first")
    return [((r.from_x, r.from_y), (r.to_x, r.to_y), float(r.n)) for r in rows]


@query()
def communities(spark: SparkSession, sf: str) -> DataFrame:
    links = _network(spark, sf)
    raw = community.communities(links, CommunityParams(trials=5))
    done = community.tidy(raw, links, grid.min_cells(CELL))
    area = community.districts(done.regions, links, CommunityParams(markov_time=0.5, trials=3))
    return spark.createDataFrame([(x, y, r, area[r]) for (x, y), r in sorted(done.regions.items())], "cell_x int, cell_y int, region int, district int")


@query()
def display_fill(spark: SparkSession, sf: str) -> DataFrame:
    links = _network(spark, sf)
    of = community.tidy(community.communities(links, CommunityParams(trials=1)), links, 1).regions
    thin = {c: r for c, r in of.items() if (c[0] + c[1]) % 3}
    ring = [(0.0, 0.0), (5400.0, 0.0), (5400.0, 3000.0), (0.0, 3000.0), (0.0, 0.0)]
    filled = community.display_fill(thin, community.island_cells(ring, CELL), CELL)
    return spark.createDataFrame([(x, y, r, (x, y) in set(filled.filled)) for (x, y), r in sorted(filled.regions.items())], "cell_x int, cell_y int, region int, is_filled boolean")


@query(
    f"""WITH {SESS}, m AS (SELECT *, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY user_id, s) AS n, sum(step_m) OVER (PARTITION BY user_id, s) AS total FROM sess WINDOW w AS (PARTITION BY user_id, s ORDER BY event_id))
    SELECT user_id, s, CAST(seq AS INTEGER) AS seq, round(x, 4) AS x, round(y, 4) AS y, epoch_us(ts) AS us FROM m WHERE n >= 2 AND total > 0"""
)
def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of two points or more as lines with observed vertices."""
    w = Window.partitionBy(*KEY).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    p = sessions(spark, sf).withColumn("offset_m", F.coalesce(F.sum("step_m").over(w), F.lit(0.0)))
    rows = p.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("event_id", "x", "y", "offset_m", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")))).alias("r"))
    pieces = rows.where(F.size("r") >= 2).select(*KEY, F.transform("r", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line"), F.transform("r", lambda v: F.struct(v["offset_m"].alias("offset_m"), v["us"].alias("us"))).alias("seen"))
    t = trajectory.trajectories(pieces, KEY)
    return rounded(t.select(*KEY, F.posexplode("trajectory").alias("seq", "p")).select(*KEY, "seq", "p.x", "p.y", "p.us"), 4)


@query()
def walk_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Times of the vertices of matched tracks: how many rows each piece has, and when it ends."""
    points, _, pieces = matching.match_tables(walks(spark, sf), street_grid(**BLOCKS), MatchParams(), ["user_id"], "event_id")
    at = points.where("piece is not null").join(walks(spark, sf).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), ["user_id", "event_id"])
    seen = at.groupBy("user_id", "piece").agg(F.collect_list(F.struct("offset_m", "us")).alias("seen"))
    t = trajectory.trajectories(pieces.join(seen, ["user_id", "piece"]), ["user_id"], "piece")
    return t.select("user_id", "piece", F.size("trajectory").alias("rows"), F.element_at("trajectory", -1)["us"].alias("last_us"), "problem")


BOX, WINDOW = (1000.0, 600.0, 3000.0, 2000.0), (datetime(2024, 1, 5, 8), datetime(2024, 1, 5, 12))


def _track_sql() -> str:
    lo, hi = "CASE WHEN b > a THEN greatest(0.0, (s0 - a) / (b - a)) ELSE 0.0 END", "CASE WHEN b > a THEN least(1.0, (e0 - a) / (b - a)) ELSE 1.0 END"
    for c, low, high in (("x", BOX[0], BOX[2]), ("y", BOX[1], BOX[3])):
        d, u, v = f"({c}1 - {c}0)", f"({low} - {c}0) / nullif({c}1 - {c}0, 0)", f"({high} - {c}0) / nullif({c}1 - {c}0, 0)"
        lo = f"CASE WHEN {d} = 0 THEN CASE WHEN {c}0 BETWEEN {low} AND {high} THEN {lo} ELSE 2.0 END ELSE greatest({lo}, least({u}, {v})) END"
        hi = f"CASE WHEN {d} = 0 THEN CASE WHEN {c}0 BETWEEN {low} AND {high} THEN {hi} ELSE -1.0 END ELSE least({hi}, greatest({u}, {v})) END"
    return f"""WITH {SESS}, legs AS (SELECT user_id, s, CAST(epoch_us(lag(ts) OVER w) AS DOUBLE) AS a, CAST(epoch_us(ts) AS DOUBLE) AS b, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1, CAST(epoch_us(TIMESTAMP '{WINDOW[0]}') AS DOUBLE) AS s0, CAST(epoch_us(TIMESTAMP '{WINDOW[1]}') AS DOUBLE) AS e0 FROM sess WINDOW w AS (PARTITION BY user_id, s ORDER BY ts, x, y)
    ), hits AS (SELECT DISTINCT user_id, s FROM legs WHERE a IS NOT NULL AND b >= s0 AND a < e0 AND {lo} <= {hi})
    SELECT total, user_id, s FROM (SELECT count(*) AS total FROM hits) LEFT JOIN (SELECT * FROM hits ORDER BY user_id, s LIMIT 200) ON TRUE"""


@query(_track_sql())
def track_query(spark: SparkSession, sf: str) -> DataFrame:
    serving.check_window(*WINDOW)
    points = sessions(spark, sf).select(*KEY, "ts", "x", "y")
    stamp = [F.lit(str(t)).cast("timestamp_ntz") for t in WINDOW]
    total, sample = serving.tracks_in_box(points, KEY, BOX, *stamp, 200, longest_s=SPLIT.max_gap_s)
    return total.join(sample, F.lit(True), "left").select("total", *KEY)
