"""Queries that compose scans, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import second_of_day
from ..operators.labels import dominant_names
from ..operators.network import AccessRules, accessible, build_network, classify
from ..sources.files import union_days
from .base import E, OD_ROWS, events, flow_counts, query, rounded, table

DAYS = [date(2024, 1, d) for d in (2, 3, 5, 8, 13)]
DAY_LIST = ", ".join(f"DATE '{d}'" for d in DAYS)


@query(f"WITH {E} SELECT event_id, user_id, d, event_type, round(value, 6) AS value FROM e WHERE d IN ({DAY_LIST}) AND event_type IN ('click', 'view') AND value IS NOT NULL")
def scan_dated_filter(spark: SparkSession, sf: str) -> DataFrame:
    # The list of days also bounds the scan, so that row groups outside are skipped.
    t = table(spark, sf, "events").where((F.col("ts") >= F.lit(f"{min(DAYS)}").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-14").cast("timestamp_ntz")))
    t = t.where(F.to_date("ts").isin(DAYS) & F.col("event_type").isin("click", "view") & F.col("value").isNotNull())
    return t.select("event_id", "user_id", F.to_date("ts").alias("d"), "event_type", F.round("value", 6).alias("value"))


@query(f"WITH {E} " + " UNION ALL ".join(f"SELECT event_id, d, 'day {d.day}' AS part FROM e WHERE d = DATE '{d}'" for d in DAYS[:3]))
def union_daily(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return union_days([e.where(F.col("d") == F.lit(d)).select("event_id", "d", F.lit(f"day {d.day}").alias("part")) for d in DAYS[:3]])


RULES = [("promo", [("kind", ["PROMO"])]), ("bolt", [("item", ["bolt", "gear"])]), ("house", [("brand", ["Brand#11", "Brand#12", "Brand#13"])]), ("plain", [("mood", ["cold"]), ("kind", ["ECONOMY", "STANDARD"])])]
ACCESS = AccessRules(never=["economy"], motorway=["promo"], foot=["standard"], service_private=["bolt"])


def part_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as tagged ways."""
    n = F.split("p_name", " ")
    size = F.col("p_size")
    tags = {
        "kind": F.col("p_type"), "brand": F.col("p_brand"), "mood": n[0], "item": n[1], "highway": F.when(size % 11 == 0, "service").otherwise(F.lower("p_type")), "service": n[1],
        "bicycle": F.when(size % 5 == 0, "no").when(size % 5 == 1, "yes").otherwise(""), "access": F.when(size % 7 == 0, "private").otherwise(""),
        "oneway": F.when(size % 3 == 0, "yes").when(size % 3 == 1, "-1").otherwise(""), "cycleway": F.when(size % 4 == 0, "opposite").otherwise(""),
    }
    return table(spark, sf, "part").select("p_partkey", F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]).alias("tags"))


TAGS = """t AS (
  SELECT p_partkey, p_type AS kind, p_brand AS brand, split_part(p_name, ' ', 1) AS mood, split_part(p_name, ' ', 2) AS item, CASE WHEN p_size % 11 = 0 THEN 'service' ELSE lower(p_type) END AS highway,
         CASE p_size % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE '' END AS bicycle, CASE WHEN p_size % 7 = 0 THEN 'private' ELSE '' END AS access FROM part)"""


@query(
    f"""WITH {TAGS} SELECT p_partkey,
      CASE WHEN kind = 'PROMO' THEN 'promo' WHEN item IN ('bolt', 'gear') THEN 'bolt' WHEN brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'house' WHEN mood = 'cold' OR kind IN ('ECONOMY', 'STANDARD') THEN 'plain' END AS category,
      CASE WHEN kind = 'PROMO' THEN 'kind=PROMO' WHEN item IN ('bolt', 'gear') THEN 'item=' || item WHEN brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'brand=' || brand WHEN mood = 'cold' THEN 'mood=cold' WHEN kind IN ('ECONOMY', 'STANDARD') THEN 'kind=' || kind END AS matched,
      highway <> 'economy' AND bicycle <> 'no' AND NOT (access = 'private' AND bicycle <> 'yes') AND CASE WHEN highway IN ('promo', 'standard') THEN bicycle = 'yes' ELSE NOT (highway = 'service' AND item = 'bolt') END AS is_open
    FROM t"""
)
def first_match_classifier(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.col("tags")
    c = classify(tags, RULES)
    return part_tags(spark, sf).select("p_partkey", c["category"].alias("category"), c["matched"].alias("matched"), accessible(tags, ACCESS).alias("is_open"))


@query(
    """SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS band, o_totalprice <= 1000 OR o_totalprice >= 300000 AS out_of_range, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL"""
)
def band_case(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    t = table(spark, sf, "orders").select(F.when(p < 100000, "low").when(p < 200000, "middle").otherwise("high").alias("band"), ((p <= 1000) | (p >= 300000)).alias("out_of_range"), p)
    return rounded(t.groupBy("band", "out_of_range").agg(F.count("*").alias("n"), F.sum(p).alias("total")), 2)


@query(f"WITH {E} SELECT event_id, CAST(t % 86400 AS INTEGER) AS sod, t % 86400 BETWEEN 25200 AND 34200 AS is_core, hour(ts) IN (6, 7, 8, 9) AS in_hours FROM e WHERE hour(ts) BETWEEN 5 AND 11")
def time_of_day_window(spark: SparkSession, sf: str) -> DataFrame:
    sod = second_of_day(F.col("ts"))
    return table(spark, sf, "events").where(F.hour("ts").between(5, 11)).select("event_id", sod.alias("sod"), sod.between(25200, 34200).alias("is_core"), F.hour("ts").isin(6, 7, 8, 9).alias("in_hours"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query(
    f"""WITH {E}, a AS (SELECT CAST(dayofmonth(o_orderdate) AS INTEGER) AS day, count(*) AS orders FROM orders GROUP BY ALL), b AS (SELECT CAST(dayofmonth(d) AS INTEGER) AS day, count(*) AS events FROM e WHERE d < DATE '2024-01-16' GROUP BY ALL)
    SELECT day, coalesce(orders, 0) AS orders, coalesce(events, 0) AS events FROM a FULL JOIN b USING (day)"""
)
def outer_totals(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").groupBy(F.dayofmonth("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    b = events(spark, sf).where("d < DATE '2024-01-16'").groupBy(F.dayofmonth("d").alias("day")).agg(F.count("*").alias("events"))
    return a.join(b, "day", "outer").fillna(0, ["orders", "events"])


@query(
    f"""WITH {OD_ROWS}, o AS (SELECT from_region AS region, year, month, count(*) AS sent FROM od_rows GROUP BY ALL), i AS (SELECT to_region AS region, year, month, count(*) AS got FROM od_rows GROUP BY ALL),
    g AS (SELECT n_nationkey AS region, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM nation, range(1995, 2002) a(y), range(1, 13) b(m))
    SELECT region, year, month, coalesce(sent, 0) AS sent, coalesce(got, 0) AS got, coalesce(got, 0) - coalesce(sent, 0) AS net, round(CASE WHEN coalesce(sent, 0) > 0 THEN coalesce(got, 0) / coalesce(sent, 0) END, 6) AS ratio
    FROM g LEFT JOIN o USING (region, year, month) LEFT JOIN i USING (region, year, month)"""
)
def dense_cube(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.profiles import dense, scaffold

    slim = flow_counts(spark, sf, "year", "month").withColumnRenamed("trips", "n")
    o = slim.groupBy(F.col("from_region").alias("region"), "year", "month").agg(F.sum("n").alias("sent"))
    i = slim.groupBy(F.col("to_region").alias("region"), "year", "month").agg(F.sum("n").alias("got"))
    years, months = spark.range(1995, 2002).select(F.col("id").cast("int").alias("year")), spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    g = scaffold([table(spark, sf, "nation").select(F.col("n_nationkey").alias("region")), years, months])
    d = dense(g, [o, i], ["region", "year", "month"], ["sent", "got"])
    return rounded(d.select("region", "year", "month", "sent", "got", (F.col("got") - F.col("sent")).alias("net"), F.when(F.col("sent") > 0, F.col("got") / F.col("sent")).alias("ratio")))


@query(
    """WITH n AS (SELECT c_nationkey AS nation, count(*) AS size FROM customer GROUP BY ALL), r AS (SELECT n_regionkey AS region, nation, size, row_number() OVER (PARTITION BY n_regionkey ORDER BY size DESC, nation) AS k, CAST(row_number() OVER (ORDER BY size DESC, nation) AS INTEGER) AS number FROM n JOIN nation ON nation = n_nationkey)
    SELECT region, nation, size, number, region || '-' || lpad(CAST(k AS VARCHAR), 2, '0') AS code FROM r"""
)
def rank_codes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.profiles import rank_codes as codes

    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("size"))
    r = n.join(F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))), "nation")
    # The global number runs over one row for each nation.
    return codes(r, "region", "size", "nation").withColumn("number", F.row_number().over(Window.orderBy(F.desc("size"), "nation")))


@query(
    """WITH l AS (SELECT p_size AS region, CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN '路' || p_brand ELSE p_brand END AS name, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS rank, sum(l_quantity) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
    ), own AS (SELECT * FROM l WHERE name <> '' AND (contains(name, '路') OR NOT EXISTS (SELECT 1 FROM l o WHERE o.region = l.region AND contains(o.name, '路')))
    ), best AS (SELECT region, name, min(struct_pack(r := rank, w := -weight)) AS place FROM own GROUP BY region, name
    ), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY place, name) AS k FROM best)
    SELECT region, string_agg(name, '/' ORDER BY k) AS label FROM k WHERE k <= 2 GROUP BY region"""
)
def road_label(spark: SparkSession, sf: str) -> DataFrame:
    """Two names for each size of parts, as for the roads of a region: brands by kind, then quantity, those with an ideograph first of all."""
    name = F.when((F.col("p_partkey") % 4 == 0) & (F.col("p_size") % 2 == 0), F.concat(F.lit("路"), "p_brand")).otherwise(F.col("p_brand"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("region"), name.alias("name"), F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2).alias("rank"))
    q = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("weight"))
    names = dominant_names(q.join(p, F.col("l_partkey") == F.col("p_partkey")), ["region"])
    return names.select("region", F.array_join(F.filter("names", lambda n: n != ""), "/").alias("label"))


@query(f"WITH {E} SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, round(max(abs(value)), 6) AS scale FROM e")
def global_and_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"), F.round(F.max(F.abs("value")), 6).alias("scale"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice / l_quantity, l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_tax) AS k FROM lineitem)
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE k = 1"""
)
def min_parallel(spark: SparkSession, sf: str) -> DataFrame:
    # An aggregate keeps one candidate for each pair on the map side, where a window would shuffle and sort all lines.
    u = F.col("l_extendedprice") / F.col("l_quantity")
    best = F.min(F.struct(u.alias("u"), "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_tax")).alias("b")
    g = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(best)
    return g.select("l_partkey", "l_suppkey", "b.l_orderkey", "b.l_linenumber", "b.l_extendedprice")


@query(
    """WITH c AS (SELECT o_custkey AS k, year(o_orderdate) AS y FROM orders), a AS (SELECT DISTINCT k FROM c WHERE y = 1996), b AS (SELECT DISTINCT k FROM c WHERE y = 1997)
    SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only 1996', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'neither', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT (SELECT k FROM a UNION SELECT k FROM b))"""
)
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    a, b = o.where("y = 1996").select("k"), o.where("y = 1997").select("k")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("part"), "k")
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "only 1996")).union(tag(c.subtract(a.union(b)), "neither"))


@query(
    """WITH l AS (SELECT l_suppkey, count(*) AS lines, count(*) FILTER (WHERE p_size > 25) AS big, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l.l_suppkey, lines, big, quantity, coalesce(orders, 0) AS returned_orders FROM l LEFT JOIN s ON l.l_suppkey = s.l_suppkey"""
)
def small_dim_join(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    # Lines are summed by part and supplier before they meet the dimension; Spark broadcasts it if it is small.
    slim = line.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    a = slim.join(part, "l_partkey", "left").groupBy("l_suppkey").agg(F.sum("n").alias("lines"), F.sum(F.when(F.col("p_size") > 25, F.col("n")).otherwise(0)).alias("big"), F.round(F.sum("q"), 2).alias("quantity"))
    b = line.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"))
    return a.join(b, "l_suppkey", "left").select("l_suppkey", "lines", "big", "quantity", F.coalesce("orders", F.lit(0)).alias("returned_orders"))


@query(
    """WITH n AS (SELECT l_orderkey AS osmid, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 40 ELSE 1000 + l_orderkey * 8 + l_linenumber END AS id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) - 1 AS last FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_tax, l_discount)
    ), u AS (SELECT id, count(DISTINCT osmid) AS uses FROM n GROUP BY id
    ), p AS (SELECT osmid, i, id, CAST(id * 37 % 5003 AS DOUBLE) AS x, CAST(id * 91 % 3001 AS DOUBLE) AS y, CASE WHEN i > 0 AND i < last AND uses > 1 THEN 1 ELSE 0 END AS cut FROM n JOIN u USING (id)
    ), g AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY osmid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece, lag(id) OVER w AS before, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM p WINDOW w AS (PARTITION BY osmid ORDER BY i)
    ), s AS (SELECT osmid, piece, first(before ORDER BY i) AS a, last(id ORDER BY i) AS b, sum(step) AS length_m FROM g WHERE i > 0 GROUP BY osmid, piece HAVING sum(step) > 0
    ), k AS (SELECT *, row_number() OVER (ORDER BY osmid, piece) - 1 AS segment_id FROM s)
    SELECT 2 * segment_id + dir AS edge_index, osmid, CAST(dir AS INTEGER) AS direction, CASE dir WHEN 0 THEN a ELSE b END AS u, CASE dir WHEN 0 THEN b ELSE a END AS v, round(length_m, 6) AS length_m, osmid % 5 = 0 OR CASE dir WHEN 1 THEN osmid % 3 <> 0 ELSE osmid % 3 <> 1 END AS is_legal_direction FROM k, (VALUES (0), (1)) d(dir)"""
)
def network_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as ways over their parts as nodes, some of them shared: segments between shared nodes and their two directed edges."""
    node = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 40).otherwise(1000 + F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax", "l_discount", node.alias("node"))
    refs = F.transform(F.sort_array(F.collect_list(order)), lambda v: v["node"])
    key = F.col("osmid")
    tags = F.create_map(F.lit("highway"), F.lit("path"), F.lit("oneway"), F.when(key % 3 == 0, "yes").when(key % 3 == 1, "-1").otherwise(""), F.lit("cycleway"), F.when(key % 5 == 0, "opposite").otherwise(""))
    ways = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("osmid")).agg(refs.alias("refs")).withColumn("tags", tags)
    nodes = table(spark, sf, "lineitem").select(node.alias("id")).distinct().select("id", (F.col("id") * 37 % 5003).cast("double").alias("x"), (F.col("id") * 91 % 3001).cast("double").alias("y"))
    segments, edges = build_network(ways, nodes, AccessRules())
    return rounded(edges.join(segments.select("segment_id", "osmid"), "segment_id").select("edge_index", "osmid", "direction", "u", "v", "length_m", "is_legal_direction"))


@query(
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL) SELECT year, n, abs(n - 2250) <= 0.05 * 2250 AS as_expected FROM y"""
)
def tolerance_flags(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return y.select("year", "n", (F.abs(F.col("n") - 2250) <= 0.05 * 2250).alias("as_expected"))


NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values, round(CAST(quantile_cont(CAST({c} AS DOUBLE), 0.25) AS DOUBLE), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 4) AS p95 FROM orders"
        for c in NUMERIC
    )
)
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders")
    long = t.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in NUMERIC])).alias("i", "v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.95)))
    g = long.groupBy("i").agg(F.count_if(F.col("v").isNull()).alias("missing"), F.count_distinct("v").alias("distinct_values"), q.alias("q"))
    names = F.array(*[F.lit(c) for c in NUMERIC])
    return g.select(names[F.col("i")].alias("column_name"), "missing", "distinct_values", *[F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("p25", "p50", "p95"))])


@query(
    """SELECT o_orderstatus AS status, CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_orderstatus, CASE WHEN o_totalprice < 100000 THEN 'low' ELSE 'high' END AS band, o_totalprice FROM orders) GROUP BY o_orderstatus, ROLLUP(band)"""
)
def rollup_bands(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") < 100000, "low").otherwise("high").alias("band"), "o_totalprice")
    g = t.groupingSets([[F.col("status"), F.col("band")], [F.col("status")]], F.col("status"), F.col("band")).agg(F.grouping("band").alias("g"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.select("status", F.when(F.col("g") == 1, "all").otherwise(F.col("band")).alias("band"), "n", "total")


@query("SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS near FROM events GROUP BY event_type")
def approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("x"))
    return g.select("event_type", F.col("x").alias("users"), (F.abs(F.col("a") - F.col("x")) <= 0.05 * F.col("x")).alias("near"))


@query(
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events
    ), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
    SELECT user_id, min(ts) AS start_time, max(ts) + INTERVAL 6 HOURS AS end_time, count(*) AS points FROM n GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions by gap of the events read as a stream, run to the end of what is there, the open ones too."""
    from ..session import shared_folder
    from ..streaming.sessions import all_sessions

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = all_sessions(src.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", shared_folder(spark, "stream"))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")], "points")
