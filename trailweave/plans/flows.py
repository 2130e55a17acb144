"""Queries on the flow matrix between nations of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import upper_tail_sql
from ..operators import contrast, serving, stats
from .base import CELL, OD, OD_ROWS, E, events, flow_counts, query, rounded, table, year_flows

YEARS = tuple(range(1995, 2002))
PAIR = ["from_region", "to_region"]


def year_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-filled union of the pairs of every two years: a year's rows fan out to its pairs, then meet by sum."""
    f = year_flows(spark, sf)
    pairs = spark.createDataFrame([(y, a, b) for a in YEARS for b in YEARS if a < b for y in (a, b)], "year int, year_a int, year_b int")
    out = f.join(F.broadcast(pairs), "year")
    side = lambda y: F.sum(F.when(F.col("year") == F.col(y), F.col("trips")).otherwise(0))
    return out.groupBy("year_a", "year_b", *PAIR).agg(side("year_a").alias("a"), side("year_b").alias("b"))


PAIRS = OD + f""", yp AS (SELECT CAST(a AS INTEGER) AS year_a, CAST(b AS INTEGER) AS year_b FROM range(1995, 2002) x(a), range(1995, 2002) y(b) WHERE a < b
), u AS (SELECT year_a, year_b, from_region, to_region, sum(CASE WHEN year = year_a THEN trips ELSE 0 END) AS a, sum(CASE WHEN year = year_b THEN trips ELSE 0 END) AS b FROM yp JOIN od ON year IN (year_a, year_b) GROUP BY ALL)"""


@query(f"WITH {PAIRS} SELECT year_a, year_b, count(*) AS pairs, round(corr(a, b), 6) AS pearson, round(corr(ln(1 + a), ln(1 + b)), 6) AS pearson_log FROM u GROUP BY ALL")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    u = year_pairs(spark, sf)
    return rounded(u.groupBy("year_a", "year_b").agg(F.count("*").alias("pairs"), stats.safe_corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("pearson"), stats.safe_corr(F.log1p("a"), F.log1p("b")).alias("pearson_log")))


@query(
    f"""WITH {PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY year_a, year_b ORDER BY a) + (count(*) OVER (PARTITION BY year_a, year_b, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY year_a, year_b ORDER BY b) + (count(*) OVER (PARTITION BY year_a, year_b, b) - 1) / 2.0 AS rb FROM u)
    SELECT year_a, year_b, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY ALL"""
)
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.spearman(year_pairs(spark, sf), ["year_a", "year_b"], "a", "b"))


@query(f"WITH {PAIRS} SELECT year_a, year_b, CAST(count(*) FILTER (WHERE a > 0 AND b > 0) AS BIGINT) AS shared FROM u GROUP BY ALL")
def day_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return year_pairs(spark, sf).groupBy("year_a", "year_b").agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"))


MERGED = OD + """, m AS (SELECT from_region, to_region, sum(trips) AS m FROM od GROUP BY ALL
), v AS (SELECT year, from_region, to_region, coalesce(trips, 0) AS a, m FROM (SELECT DISTINCT year FROM od) CROSS JOIN m LEFT JOIN od USING (year, from_region, to_region))"""


def against_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair in each year, absent ones 0, beside its sum over the years: one pass, as a pair has a value for each year at most."""
    g = year_flows(spark, sf).groupBy(*PAIR).agg(F.sum("trips").alias("m"), F.map_from_entries(F.collect_list(F.struct("year", "trips"))).alias("t"))
    years = F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year")
    return g.select(*PAIR, "m", "t", years).select("year", *PAIR, F.coalesce(F.col("t")[F.col("year")], F.lit(0)).alias("a"), "m")


@query(f"WITH {MERGED} SELECT year, round(CASE WHEN sum(a * a) > 0 THEN sum(a * m) / sqrt(sum(CAST(a * a AS DOUBLE)) * sum(CAST(m * m AS DOUBLE))) END, 6) AS cosine FROM v GROUP BY year")
def share_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(against_merged(spark, sf).groupBy("year").agg(stats.cosine(F.col("a").cast("double"), F.col("m").cast("double")).alias("cosine")))


@query(
    f"""WITH {OD}, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY trips DESC, from_region, to_region) AS k FROM od), ks(top) AS (VALUES (50), (200)), yp AS (SELECT CAST(a AS INTEGER) AS year_a, CAST(b AS INTEGER) AS year_b FROM range(1995, 2002) x(a), range(1995, 2002) y(b) WHERE a < b
    ), s AS (SELECT CAST(top AS INTEGER) AS top, year_a, year_b, from_region, to_region, max(CASE WHEN year = year_a THEN 1 ELSE 0 END) AS a, max(CASE WHEN year = year_b THEN 1 ELSE 0 END) AS b FROM ks JOIN r ON k <= top JOIN yp ON year IN (year_a, year_b) GROUP BY ALL)
    SELECT top, year_a, year_b, round(sum(a * b) / count(*), 6) AS jaccard, round(sum(a * b) / sum(a), 6) AS covered FROM s GROUP BY ALL"""
)
def topk_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("year").orderBy(F.desc("trips"), *PAIR)
    r = year_flows(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 200")
    tops = r.withColumn("top", F.explode(F.array(F.lit(50), F.lit(200)))).where("k <= top")
    pairs = spark.createDataFrame([(y, a, b) for a in YEARS for b in YEARS if a < b for y in (a, b)], "year int, year_a int, year_b int")
    s = tops.join(F.broadcast(pairs), "year").groupBy("top", "year_a", "year_b", *PAIR).agg(F.bool_or(F.col("year") == F.col("year_a")).alias("a"), F.bool_or(F.col("year") == F.col("year_b")).alias("b"))
    return rounded(s.groupBy("top", "year_a", "year_b").agg(stats.jaccard(F.col("a"), F.col("b")).alias("jaccard"), stats.coverage(F.col("a"), F.col("b")).alias("covered")))


@query(f"WITH {OD} SELECT year, CAST(sum(trips) AS BIGINT) AS trips, round(sum(CASE WHEN from_region = to_region THEN trips ELSE 0 END) / sum(trips), 6) AS self_share FROM od GROUP BY year")
def self_loop_share(spark: SparkSession, sf: str) -> DataFrame:
    own = F.sum(F.when(F.col("from_region") == F.col("to_region"), F.col("trips")).otherwise(0))
    return rounded(year_flows(spark, sf).groupBy("year").agg(F.sum("trips").alias("trips"), (own / F.sum("trips")).alias("self_share")))


@query(
    f"""WITH {OD_ROWS}, b AS (SELECT year, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM od_rows WHERE year BETWEEN 1995 AND 1999 GROUP BY ALL
    ), x AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS exposure FROM orders GROUP BY ALL), r AS (SELECT band, year, n / exposure AS rate FROM b JOIN x USING (year)
    ), q AS (SELECT band, max(rate) FILTER (WHERE year = 1997) / avg(rate) FILTER (WHERE year <> 1997) AS ratio FROM r GROUP BY band)
    SELECT band, round(ratio, 6) AS ratio, round((max(ratio) OVER () - min(ratio) OVER ()) / avg(ratio) OVER (), 6) AS spread, band = first_value(band) OVER (ORDER BY abs(ratio - (SELECT avg(ratio) FROM q)) DESC, band) AS is_furthest FROM q"""
)
def exposure_ratio(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    band = F.when(p < 100000, "low").when(p < 200000, "middle").otherwise("high")
    b = flow_counts(spark, sf, "year", band=band).where("year between 1995 and 1999").groupBy("year", "band").agg(F.sum("trips").alias("n"))
    x = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("exposure"))
    r = b.join(x, "year").withColumn("rate", F.col("n") / F.col("exposure"))
    q = r.groupBy("band").agg((F.max(F.when(F.col("year") == 1997, F.col("rate"))) / F.avg(F.when(F.col("year") != 1997, F.col("rate")))).alias("ratio"))
    s = q.agg(((F.max("ratio") - F.min("ratio")) / F.avg("ratio")).alias("spread"), F.avg("ratio").alias("mean"), F.collect_list(F.struct("band", "ratio")).alias("all"))
    s = s.withColumn("far", F.array_min(F.transform("all", lambda v: F.struct((-F.abs(v["ratio"] - F.col("mean"))).alias("o"), v["band"].alias("band"))))["band"])
    return rounded(q.crossJoin(F.broadcast(s)).select("band", "ratio", "spread", (F.col("band") == F.col("far")).alias("is_furthest")))


NULLS = OD + """, m AS (SELECT *, CAST(sum(trips) OVER (PARTITION BY year) AS DOUBLE) AS n, CAST(sum(trips) OVER (PARTITION BY year, from_region) AS DOUBLE) AS r, CAST(sum(trips) OVER (PARTITION BY year, to_region) AS DOUBLE) AS c FROM od
), odn AS (SELECT *, r * c / n AS null_mean, sqrt(greatest(r * (c / n) * (1 - c / n) * (n - r) / (n - 1), 0)) AS null_sd FROM m
), w AS (SELECT *, r * c / sum(r * c) OVER (PARTITION BY year) AS p FROM m
), chn AS (SELECT *, n * p AS null_mean, sqrt(n * p * (1 - p)) AS null_sd FROM w)"""


@query(f"WITH {NULLS} SELECT year, from_region, to_region, trips, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd FROM odn")
def null_moments_od(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.od_null(year_flows(spark, sf), ["year"]))


@query(f"WITH {NULLS} SELECT year, from_region, to_region, trips, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd FROM chn")
def null_moments_channel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.channel_null(year_flows(spark, sf), ["year"], "trips"))


def _sig(fdr: float) -> str:
    return NULLS + f""", z AS (SELECT year, from_region, to_region, trips, CASE WHEN null_sd > 0 THEN (trips - null_mean) / null_sd END AS z, trips < 5 AS gated, from_region = to_region AS is_self_loop FROM odn
), p AS (SELECT *, {upper_tail_sql("z")} AS p FROM z
), t AS (SELECT year, from_region, to_region, p * count(*) OVER (PARTITION BY year) / row_number() OVER w AS scaled, row_number() OVER w AS k FROM p WHERE NOT gated AND NOT is_self_loop AND p IS NOT NULL WINDOW w AS (PARTITION BY year ORDER BY p, from_region, to_region)
), q AS (SELECT *, least(1.0, min(scaled) OVER (PARTITION BY year ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM t
), sig AS (SELECT p.*, q.q, coalesce(q.q <= {fdr}, FALSE) AS is_significant FROM p LEFT JOIN q USING (year, from_region, to_region))"""


#: False discovery rates of the queries: the flows of the test data are near their null, so stable pairs are few even at a rate that takes most.
FDR, STABLE_FDR = 0.2, 0.95
SIG, STABLE_SIG = _sig(FDR), _sig(STABLE_FDR)


def sig_rows(spark: SparkSession, sf: str, fdr: float = FDR) -> DataFrame:
    return stats.significance(stats.od_null(year_flows(spark, sf), ["year"]), ["year"], "trips", 5, fdr)


@query(f"WITH {SIG} SELECT year, from_region, to_region, trips, round(z, 6) AS z, round(p, 8) AS p, round(q, 8) AS q, gated, is_self_loop, is_significant FROM sig")
def significance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sig_rows(spark, sf).select("year", *PAIR, "trips", "z", "p", "q", "gated", "is_self_loop", "is_significant"), 6, p=8, q=8)


@query(f"WITH {STABLE_SIG} SELECT from_region, to_region, count(DISTINCT year) AS scopes, round(min(z), 6) AS z_min, round(quantile_cont(z, 0.5), 6) AS z_median FROM sig WHERE is_significant AND year <= 1998 GROUP BY ALL HAVING count(DISTINCT year) = 4")
def stable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.stable_pairs(sig_rows(spark, sf, STABLE_FDR).where("year <= 1998"), "year", 4))


@query(
    f"""WITH {OD}, r AS (SELECT *, row_number() OVER (PARTITION BY year, from_region ORDER BY trips DESC, to_region) AS k, row_number() OVER (PARTITION BY year, from_region ORDER BY abs(trips - 10), to_region) AS near FROM od)
    SELECT year, from_region, max(to_region) FILTER (WHERE k = 1) AS best, max(trips) FILTER (WHERE k = 1) AS most, max(to_region) FILTER (WHERE near = 1) AS nearest_to_ten, abs(max(trips) FILTER (WHERE near = 1) - 10) > 5 AS capped FROM r GROUP BY ALL"""
)
def argmax_group(spark: SparkSession, sf: str) -> DataFrame:
    g = year_flows(spark, sf).groupBy("year", "from_region").agg(F.min(F.struct((-F.col("trips")).alias("o"), "to_region")).alias("b"), F.min(F.struct(F.abs(F.col("trips") - 10).alias("o"), "to_region")).alias("t"))
    return g.select("year", "from_region", F.col("b.to_region").alias("best"), (-F.col("b.o")).alias("most"), F.col("t.to_region").alias("nearest_to_ten"), (F.col("t.o") > 5).alias("capped"))


@query(
    f"""WITH {OD}, a AS (SELECT from_region, to_region, trips AS a FROM od WHERE year = 1996), b AS (SELECT from_region, to_region, trips AS b FROM od WHERE year = 1998), j AS (SELECT abs(b - a) / a AS d, a, b FROM a JOIN b USING (from_region, to_region))
    SELECT count(*) AS pairs, round(quantile_cont(d, 0.5), 6) AS median_difference, round(sum(a) / sum(b), 6) AS ratio, (SELECT count(*) FROM a) = count(*) AS is_complete FROM j"""
)
def merge_contrast(spark: SparkSession, sf: str) -> DataFrame:
    f = year_flows(spark, sf).where("year in (1996, 1998)").groupBy(*PAIR).agg(F.sum(F.when(F.col("year") == 1996, F.col("trips"))).alias("a"), F.sum(F.when(F.col("year") == 1998, F.col("trips"))).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    d = F.when(both, F.abs(F.col("b") - F.col("a")) / F.col("a"))
    g = f.agg(F.count(d).alias("pairs"), F.percentile(d, F.lit(0.5)).alias("median_difference"), (F.sum(F.when(both, F.col("a"))) / F.sum(F.when(both, F.col("b")))).alias("ratio"), (F.count("a") == F.count(d)).alias("is_complete"))
    return rounded(g)


TOP = 50


@query(
    f"""WITH {MERGED}, ys AS (SELECT DISTINCT year FROM od), cube AS (SELECT y.year, m.from_region, m.to_region, coalesce(trips, 0) AS trips, m FROM ys y CROSS JOIN m LEFT JOIN od USING (year, from_region, to_region)
    ), two AS (
      SELECT 'pair' AS family, a.year, b.year AS other, a.from_region, a.to_region, a.trips AS a, b.trips AS b FROM cube a JOIN cube b ON a.year < b.year AND a.from_region = b.from_region AND a.to_region = b.to_region WHERE a.trips + b.trips > 0
      UNION ALL SELECT 'merged', year, NULL, from_region, to_region, trips, m FROM cube
    ), ranked AS (
      SELECT *, rank() OVER (PARTITION BY family, year, other ORDER BY a) + (count(*) OVER (PARTITION BY family, year, other, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY family, year, other ORDER BY b) + (count(*) OVER (PARTITION BY family, year, other, b) - 1) / 2.0 AS rb,
        a > 0 AND row_number() OVER (PARTITION BY family, year, other ORDER BY a DESC, from_region, to_region) <= {TOP} AS ta, b > 0 AND row_number() OVER (PARTITION BY family, year, other ORDER BY b DESC, from_region, to_region) <= {TOP} AS tb FROM two
    ), wide AS (
      SELECT family, year, other, count(*) AS n, corr(a, b) AS pearson, corr(ln(1 + a), ln(1 + b)) AS pearson_log, corr(ra, rb) AS spearman, sum(CAST(a AS DOUBLE) * b) / nullif(sqrt(sum(CAST(a AS DOUBLE) * a) * sum(CAST(b AS DOUBLE) * b)), 0) AS cosine,
        count(*) FILTER (WHERE ta AND tb) / nullif(count(*) FILTER (WHERE ta OR tb), 0) AS top_jaccard FROM ranked GROUP BY family, year, other
    ), long AS (
      UNPIVOT wide ON pearson, pearson_log, spearman, cosine, top_jaccard INTO NAME metric VALUE value)
    SELECT family, metric, CAST(year AS INTEGER) AS year, CAST(other AS INTEGER) AS other, CAST(NULL AS INTEGER) AS region, round(value, 6) AS value, n FROM long
    UNION ALL SELECT 'region', 'self share', NULL, NULL, from_region, round(sum(CASE WHEN from_region = to_region THEN m ELSE 0 END) / sum(m), 6), count(*) FROM m GROUP BY from_region"""
)
def consistency_long(spark: SparkSession, sf: str) -> DataFrame:
    """How alike the years are, pair by pair and against their sum, and the share of each region that stays: all from one table of pairs, built once."""
    g = year_flows(spark, sf).groupBy(*PAIR).agg(F.sum("trips").alias("m"), F.map_from_entries(F.collect_list(F.struct("year", "trips"))).alias("t"))
    at = lambda y: F.coalesce(F.col("t")[F.lit(y)], F.lit(0))
    none = F.lit(None).cast("int")
    row = lambda family, y, z, a, b: F.struct(F.lit(family).alias("family"), y.cast("int").alias("year"), z.cast("int").alias("other"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    rows = [row("pair", F.lit(y), F.lit(z), at(y), at(z)) for y in YEARS for z in YEARS if y < z] + [row("merged", F.lit(y), none, at(y), F.col("m")) for y in YEARS]
    both = g.select(*PAIR, F.explode(F.array(*rows)).alias("r")).select(*PAIR, "r.*").where("family = 'merged' or a + b > 0")
    by = ["family", "year", "other"]
    both = stats.average_rank(stats.average_rank(both, by, "a", "ra"), by, "b", "rb")
    top = lambda c: (F.col(c) > 0) & (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), *PAIR)) <= TOP)
    both = both.withColumns({"ta": top("a"), "tb": top("b")})
    a, b = F.col("a"), F.col("b")
    wide = both.groupBy(*by).agg(F.count("*").alias("n"), stats.safe_corr(a, b).alias("pearson"), stats.safe_corr(F.log1p("a"), F.log1p("b")).alias("pearson_log"), stats.safe_corr(F.col("ra"), F.col("rb")).alias("spearman"), stats.cosine(a, b).alias("cosine"), stats.jaccard(F.col("ta"), F.col("tb")).alias("top_jaccard"))
    long = wide.unpivot([*by, "n"], ["pearson", "pearson_log", "spearman", "cosine", "top_jaccard"], "metric", "value").where("value is not null").select("family", "metric", "year", "other", none.alias("region"), "value", "n")
    stay = g.groupBy("from_region").agg((F.sum(F.when(F.col("from_region") == F.col("to_region"), F.col("m")).otherwise(0)) / F.sum("m")).alias("value"), F.count("*").alias("n"))
    out = long.union(stay.select(F.lit("region"), F.lit("self share"), none, none, "from_region", "value", "n"))
    return rounded(out).orderBy("family", "metric", F.col("year").asc_nulls_first(), F.col("other").asc_nulls_first(), F.col("region").asc_nulls_first())


RAIN, CLEAR = 1997, (1995, 1996, 1998, 1999)


@query(
    f"""WITH {OD_ROWS}, rows AS (SELECT year, from_region, to_region, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS band FROM od_rows WHERE year IN {(RAIN, *CLEAR)}
    ), x AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS exposure FROM orders GROUP BY ALL
    ), b AS (SELECT band, year, count(*) AS n FROM rows GROUP BY ALL UNION ALL SELECT 'all', year, count(*) FROM rows GROUP BY year
    ), r AS (SELECT band, max(n / exposure) FILTER (WHERE year = {RAIN}) / avg(n / exposure) FILTER (WHERE year <> {RAIN}) AS ratio FROM b JOIN x USING (year) GROUP BY band
    ), bands AS (SELECT band, ratio FROM r WHERE band <> 'all'), mid AS (SELECT avg(ratio) AS mean, max(ratio) - min(ratio) AS spread FROM bands
    ), far AS (SELECT band, abs(ratio - mean) AS off FROM bands, mid ORDER BY off DESC, band LIMIT 1
    ), pairs AS (SELECT from_region, to_region, count(*) FILTER (WHERE year = {RAIN}) AS a, count(*) FILTER (WHERE year <> {RAIN}) AS b FROM rows WHERE from_region <> to_region GROUP BY ALL
    ), shares AS (SELECT a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM pairs
    ), ranks AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM shares
    ), own AS (SELECT year, count(*) FILTER (WHERE from_region = to_region) / count(*) AS share FROM rows GROUP BY year)
    SELECT 'exposure_ratio' AS metric, band, round(ratio, 6) AS value FROM r
    UNION ALL SELECT 'band_spread', NULL, round(spread, 6) FROM mid
    UNION ALL SELECT 'band_furthest', band, round(off, 6) FROM far
    UNION ALL SELECT 'share_spearman', NULL, round(corr(ra, rb), 6) FROM ranks
    UNION ALL SELECT 'share_cosine', NULL, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) FROM shares
    UNION ALL SELECT 'self_loop_ratio', NULL, round(max(share) FILTER (WHERE year = {RAIN}) / avg(share) FILTER (WHERE year <> {RAIN}), 6) FROM own"""
)
def rain_contrast(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    band = F.when(p < 100000, "low").when(p < 200000, "middle").otherwise("high")
    counts = flow_counts(spark, sf, "year", band=band).withColumnsRenamed({"year": "day", "trips": "n"})
    exposure = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("day")).agg(F.count("*").alias("exposure"))
    return rounded(contrast.day_contrast(counts, exposure, RAIN, CLEAR).select("metric", "band", "value"))


@query(
    f"""WITH {OD_ROWS}, c AS (SELECT from_region AS region, year, count(DISTINCT month) AS months, count(*) AS n FROM od_rows WHERE year BETWEEN 1995 AND 2000 GROUP BY ALL)
    SELECT region, CASE WHEN count(*) = 6 AND min(months) = 12 THEN CAST(sum(n) AS BIGINT) END AS total, bool_and(n >= 80) AS always_busy, count(*) = 6 AND min(months) = 12 AS is_complete FROM c GROUP BY region"""
)
def selection_complete(spark: SparkSession, sf: str) -> DataFrame:
    c = flow_counts(spark, sf, "year", "month").where("year between 1995 and 2000").groupBy(F.col("from_region").alias("region"), "year", "month").agg(F.sum("trips").alias("n")).groupBy("region", "year").agg(F.count("*").alias("months"), F.sum("n").alias("n"))
    full = (F.count("*") == 6) & (F.min("months") == 12)
    return c.groupBy("region").agg(F.when(full, F.sum("n")).alias("total"), F.bool_and(F.col("n") >= 80).alias("always_busy"), full.alias("is_complete"))


@query(
    f"""WITH {OD}, m AS (SELECT a.n_regionkey AS from_district, b.n_regionkey AS to_district, CAST(sum(trips) AS BIGINT) AS trips FROM od JOIN nation a ON from_region = a.n_nationkey JOIN nation b ON to_region = b.n_nationkey WHERE from_region <> to_region GROUP BY ALL)
    SELECT * FROM m WHERE from_district <> to_district ORDER BY trips DESC, from_district, to_district LIMIT 50"""
)
def district_rollup(spark: SparkSession, sf: str) -> DataFrame:
    n = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"))
    f = year_flows(spark, sf).where("from_region <> to_region").groupBy(*PAIR).agg(F.sum("trips").alias("trips"))
    j = f.join(n.select(F.col("n_nationkey").alias("from_region"), F.col("n_regionkey").alias("from_district")), "from_region").join(n.select(F.col("n_nationkey").alias("to_region"), F.col("n_regionkey").alias("to_district")), "to_region")
    return j.where("from_district <> to_district").groupBy("from_district", "to_district").agg(F.sum("trips").alias("trips")).orderBy(F.desc("trips"), "from_district", "to_district").limit(50)


def two_grids(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.groupBy((F.floor(F.col("x") / CELL) * 10 + F.floor(F.col("y") / CELL)).cast("int").alias("a"), (F.floor(F.col("x") / 900.0) * 10 + F.floor(F.col("y") / 900.0)).cast("int").alias("b")).agg(F.count("*").alias("n"))


GRIDS = E + f""", c AS (SELECT CAST(floor(x / {CELL}) * 10 + floor(y / {CELL}) AS INTEGER) AS a, CAST(floor(x / 900.0) * 10 + floor(y / 900.0) AS INTEGER) AS b, count(*) AS n FROM e GROUP BY ALL)"""


@query(f"WITH {GRIDS}, s AS (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS sa, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS sb FROM c) SELECT round(sum(n * (1 - (n * abs(1 / sa - 1 / sb) + (sa - n) / sa + (sb - n) / sb) / 2)) / sum(n), 6) AS similarity FROM s")
def contingency_ecs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.element_similarity(two_grids(spark, sf), "a", "b", "n"))


@query()
def ami(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.adjusted_mutual_information(two_grids(spark, sf), "a", "b", "n"))


@query(
    f"""WITH {SIG}, o AS (SELECT year, month, from_region, to_region, count(*) AS n FROM od_rows GROUP BY ALL), ww AS (SELECT from_region, to_region, CAST(sum(n) AS DOUBLE) AS weight FROM o WHERE year = 1997 AND month = 3 GROUP BY ALL)
    SELECT '1997' AS scope, 3 AS slot, from_region, to_region, round(coalesce(weight, 0.0), 6) AS weight, s.year IS NOT NULL AS is_tested, s.trips AS observed, is_significant, gated, is_self_loop FROM (SELECT * FROM sig WHERE year = 1997) s FULL JOIN ww USING (from_region, to_region)"""
)
def flows_sql(spark: SparkSession, sf: str) -> DataFrame:
    s = sig_rows(spark, sf).select(F.col("year").cast("string").alias("scope"), *PAIR, F.col("trips").alias("observed"), "is_significant", "gated", "is_self_loop")
    o = flow_counts(spark, sf, "year", "month").select(F.col("year").cast("string").alias("scope"), F.col("month").alias("slot"), *PAIR, F.col("trips").alias("n"))
    return rounded(serving.flows(s, o, "1997", [str(y) for y in YEARS], 3))


@query(
    f"""WITH {STABLE_SIG}, st AS (SELECT from_region, to_region, sum(trips) AS observed FROM sig WHERE is_significant AND year <= 1998 GROUP BY ALL HAVING count(*) = 4), o AS (SELECT from_region, to_region, count(*) AS n FROM od_rows WHERE month = 3 AND year <= 1998 GROUP BY ALL)
    SELECT from_region, to_region, round(coalesce(n, 0) / 4.0, 6) AS weight, CAST(observed AS BIGINT) AS observed FROM st LEFT JOIN o USING (from_region, to_region)"""
)
def flows_stable(spark: SparkSession, sf: str) -> DataFrame:
    tested = sig_rows(spark, sf, STABLE_FDR).where("year <= 1998")
    s = stats.stable_pairs(tested, "year", 4).join(tested.groupBy(*PAIR).agg(F.sum("trips").alias("observed")), PAIR)
    s = s.select(F.lit("stable").alias("scope"), *PAIR, "observed", F.lit(True).alias("is_significant"), F.lit(False).alias("gated"), F.lit(False).alias("is_self_loop"))
    o = flow_counts(spark, sf, "year", "month").select(F.col("year").cast("string").alias("scope"), F.col("month").alias("slot"), *PAIR, F.col("trips").alias("n"))
    return rounded(serving.flows(s, o, "stable", ["1995", "1996", "1997", "1998"], 3).select(*PAIR, "weight", "observed"))


@query()
def replicate_null(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.replicate_null(year_flows(spark, sf), "year", "trips", 100, "20201221"))
