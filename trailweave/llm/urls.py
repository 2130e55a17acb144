"""URL filter with redirect equivalence.

Rules name a host, with all its subdomains, and the start of a path; the longest
rule that fits decides. Redirects and canonical links of pages make addresses
aliases of each other: within a connected component an explicit allow goes
before any block, and a block reaches every alias that no rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, adopt, table

Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_of(url: Column) -> Column:
    """Name of an address: host, path and query. Scheme and fragment make no difference."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A[^#]*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(host_of(url), path_of(url), query)


def absolute(target: Column, base: Column) -> Column:
    """A link's target resolved against the page's address (RFC 3986): with a scheme, from ``//``, from ``/``, a query, a fragment, or relative to the page's folder, dot segments removed. Null for an empty target and schemes without ``://``."""
    scheme = F.regexp_extract(base, r"(?s)\A(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1)
    path = path_of(base)
    own = F.regexp_extract(target, r"(?s)\A([^?#]*)", 1)
    tail = F.regexp_extract(target, r"(?s)\A[^?#]*(.*)", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)\A(.*/)", 1)), own))
    # Segments of the path after its first slash; ".." takes the one before, and a last dot segment leaves a slash.
    parts = F.split(F.substring(joined, 2, 1 << 30), "/", -1)
    kept = F.aggregate(F.slice(parts, 1, F.size(parts)), F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    closed = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), closed)
    query = F.when(tail.startswith("?"), "").otherwise(F.regexp_extract(base, r"(?s)\A[^#?]*(\?[^#]*)", 1))
    here = F.concat(site, path, query, tail)
    return (
        F.when(target == "", None)
        .when(target.rlike(r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(own == "", here)
        .otherwise(F.concat(site, clean, tail))
    )


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does. Equal lengths: allow first, then the smaller rule."""
    order = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    fits = [((host == r[1]) | host.endswith(f".{r[1]}")) & path.startswith(r[2]) for r in order]
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r, fit in reversed(list(zip(order, fits, strict=True))):
        out = F.when(fit, F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: Column) -> Column:
    """The host and every host above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_by_join(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``best`` (as of ``best_rule``) for each distinct (host, path), from a table of rules (action, host, path) of any size.

    A host meets the lengths of the paths that rules of it or of a host above it
    have; the starts of its path of those lengths then meet the rules by
    equality, so no rule is compared with addresses that it doesn't fit.
    """
    rules = rules.select(F.col("action").alias("verdict"), F.col("host").alias("at"), F.col("path").alias("start")).where("at is not null and start is not null").distinct()
    lengths = rules.select("at", F.length("start").alias("n")).distinct()
    spots = addresses.select("host", "path").distinct()
    starts = spots.withColumn("at", F.explode(suffixes(F.col("host")))).join(lengths, "at").where(F.length("path") >= F.col("n")).select("host", "path", "at", F.expr("substring(path, 1, n)").alias("start"))
    rule = F.concat("at", "start")
    first = F.struct((-F.length(rule)).alias("l"), "verdict", rule.alias("rule"))
    return starts.join(rules, ["at", "start"]).groupBy("host", "path").agg(F.min(first).alias("f")).select("host", "path", F.struct("f.rule", "f.verdict").alias("best"))


#: What of a page declares nothing: comments, and what scripts, styles, templates and text fields hold.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<template\b.*?(?:</template\b|\z)|<noscript\b.*?(?:</noscript\b|\z)|<textarea\b.*?(?:</textarea\b|\z)|<title\b.*?(?:</title\b|\z)"
#: Character references that addresses hold, with what they stand for; that of the ampersand comes last.
REFERENCES = ((r"(?i)&(?:#x0*2f|#0*47|sol);", "/"), (r"(?i)&(?:#x0*3a|#0*58|colon);", ":"), (r"(?i)&(?:#x0*3f|#0*63|quest);", "?"), (r"(?i)&(?:#x0*3d|#0*61|equals);", "="), (r"(?i)&(?:#x0*22|#0*34|quot);", '"'), (r"(?i)&(?:#x0*27|#0*39|apos);", "'"), (r"(?i)&(?:#x0*3c|#0*60|lt);", "<"), (r"(?i)&(?:#x0*3e|#0*62|gt);", ">"), (r"(?i)&(?:#x0*26|#0*38|amp);", "&"))


def decoded(text: Column) -> Column:
    """An attribute's value without character references."""
    for pattern, meant in REFERENCES:
        text = F.regexp_replace(text, pattern, meant)
    return text


def page_links(pages: DataFrame) -> DataFrame:
    """Alias pairs (a, b) that redirects (meta refresh) and canonical links of the pages declare, targets resolved against the page's url. Comments, scripts and other parts that show no tags declare none; a link counts wherever else it stands."""
    html = F.regexp_replace("html", HIDDEN, " ")
    tag = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag")
    tags = pages.where(F.col("url").contains("://") & F.col("html").isNotNull() & F.col("html").rlike(r"(?i)canonical|refresh")).select("url", tag)
    href = F.regexp_extract("tag", r"(?is)[\s\"'/]href\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    refresh = F.regexp_extract("tag", r"(?is)[\s\"'/]content\s*=\s*[\"']?\s*[\d.]*\s*;?\s*url\s*=\s*[\"']?([^\"'>\s]+)", 1)
    target = F.when(F.col("tag").rlike(r"(?is)^<link\b.*[\s\"'/]rel\s*=\s*[\"']?\s*canonical\b"), href).when(F.col("tag").rlike(r"(?is)^<meta\b.*[\s\"'/]http-equiv\s*=\s*[\"']?\s*refresh\b"), refresh)
    links = tags.select("url", decoded(target).alias("to")).where("to is not null").select("url", absolute(F.col("to"), F.col("url")).alias("to"))
    return links.where("to is not null").select(alias_of(F.col("url")).alias("a"), alias_of(F.col("to")).alias("b"))


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, links: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Verdict of each page: page_id, host, path, rule, verdict, by.

    ``rules`` are a short list, or a table (action, host, path) of any size,
    which is joined. ``links`` are further pairs of urls (source, target), such
    as redirects met while crawling. ``by`` says what decided: rule, alias or default. Null urls
    and those without ``://`` have empty host and path, fit no rule and have no
    aliases. Rows that repeat are judged alike. Empty tables give empty results
    and other columns are ignored.
    """
    pages = adopt(pages)
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url")
    read = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))

    def with_best(rows: DataFrame) -> DataFrame:
        if isinstance(rules, DataFrame):
            return rows.join(rules_by_join(rows, adopt(rules, rows.sparkSession)), ["host", "path"], "left")
        return rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))

    read = with_best(read)
    edges = page_links(pages)
    if links is not None:
        edges = edges.union(links.where("source is not null and target is not null and instr(source, '://') > 0 and instr(target, '://') > 0").select(alias_of(F.col("source")), alias_of(F.col("target"))))
    edges = scratch.keep(edges.where("a <> b").distinct())
    verdict = F.col("best.verdict")
    if edges.isEmpty():
        told = read.withColumn("spread", F.lit(None).cast("string"))
    else:
        nodes = scratch.keep(connected_components(edges))
        # A node is judged by its own address, so that pages never crawled count too.
        own = with_best(nodes.select("component", F.regexp_extract("node", r"(?s)\A[^/?#]*", 0).alias("host"), F.regexp_extract("node", r"(?s)\A[^/?#]*([^?#]*)", 1).alias("path")))
        groups = own.groupBy("component").agg(F.max((verdict == "allow").cast("int")).alias("allow"), F.max((verdict == "block").cast("int")).alias("block"))
        spread = scratch.keep(nodes.join(groups, "component").select(F.col("node").alias("alias"), F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").alias("spread")).where("spread is not null"))
        told = read.withColumn("alias", F.when(F.col("url").contains("://"), alias_of(url))).join(spread, "alias", "left")
    return told.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(verdict, "spread", F.lit(default)).alias("verdict"), F.when(verdict.isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default").alias("by"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_DECODE = "coded"
for _pattern, _meant in REFERENCES:
    _DECODE = f"regexp_replace({_DECODE}, '{_pattern}', '{_meant.replace(chr(39), chr(39) * 2)}', 'g')"

OP4_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(action, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), tags AS (
  SELECT host || path || regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) AS a, url, path,
         unnest(regexp_extract_all(regexp_replace(html, '""" + HIDDEN + r"""', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM p WHERE instr(url, '://') > 0
), targets AS (
  SELECT a, url, path, CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*[\s"''/]rel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*[\s"''/]http-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)[\s"''/]content\s*=\s*["'']?\s*[\d.]*\s*;?\s*url\s*=\s*["'']?([^"''>\s]+)', 1)
  END AS coded FROM tags
), decoded AS (
  SELECT a, url, path, """ + _DECODE + r""" AS target FROM targets WHERE coded <> ''
), split AS (
  SELECT *, regexp_extract(target, '^([^?#]*)', 1) AS own, regexp_extract(target, '^[^?#]*((?s:.*))', 1) AS tail, regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) AS site FROM decoded
), parted AS (
  SELECT *, string_split(substr(CASE WHEN starts_with(own, '/') THEN own WHEN path = '' THEN '/' || own ELSE regexp_extract(path, '^((?s:.*)/)', 1) || own END, 2), '/') AS parts FROM split
), dotless AS (
  SELECT *, list_reduce([CAST([] AS VARCHAR[])] || list_transform(parts, lambda x: [x]), lambda done, p: CASE p[1] WHEN '..' THEN done[1:len(done) - 1] WHEN '.' THEN done ELSE done || p END) AS kept FROM parted
), full_target AS (
  SELECT a, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '^((?s:.*?))://', 1) || ':' || target
    WHEN target = '' OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN own = '' THEN site || path || CASE WHEN starts_with(tail, '?') THEN '' ELSE regexp_extract(url, '^[^#?]*(\?[^#]*)', 1) END || tail
    ELSE site || '/' || coalesce(array_to_string(kept, '/'), '') || CASE WHEN parts[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END || tail
  END AS target FROM dotless
), edges AS (
  SELECT a, translate(regexp_extract(target, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(target, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS b
  FROM full_target WHERE target IS NOT NULL
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
  SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), node_rule AS (
  SELECT n.b, first(r.action ORDER BY length(r.h || r.q) DESC, r.action) AS action
  FROM (SELECT DISTINCT b FROM reach) n JOIN rules r
    ON (regexp_extract(n.b, '^[^/?#]*') = r.h OR suffix(regexp_extract(n.b, '^[^/?#]*'), '.' || r.h))
   AND starts_with(regexp_extract(n.b, '^[^/?#]*([^?#]*)', 1), r.q)
  GROUP BY n.b
), spread AS (SELECT r.a, CASE WHEN bool_or(n.action = 'allow') THEN 'allow' ELSE 'block' END AS v FROM reach r JOIN node_rule n USING (b) GROUP BY r.a
), own AS (
  SELECT p.page_id, p.url, p.host, p.path, row_number() OVER () AS k FROM p
), best AS (
  SELECT k, first(r.h || r.q ORDER BY length(r.h || r.q) DESC, r.action) AS rule, first(r.action ORDER BY length(r.h || r.q) DESC, r.action) AS action
  FROM own JOIN rules r ON (host = r.h OR suffix(host, '.' || r.h)) AND starts_with(path, r.q) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(action, v, 'allow') AS verdict,
       CASE WHEN action IS NOT NULL THEN 'rule' WHEN v IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM own LEFT JOIN best USING (k)
LEFT JOIN spread ON instr(url, '://') > 0 AND spread.a = host || path || regexp_extract(url, '://[^?#]*(\?[^#]*)', 1)
"""
