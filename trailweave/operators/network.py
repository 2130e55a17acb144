"""A directed road network and classified features from tagged ways and nodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Way ids that are numbered together.
RANGE = 1 << 16


@dataclass(frozen=True)
class AccessRules:
    """Values of tags that open or close a way to bicycles; given by the caller, since they are local knowledge."""

    never: Sequence[str] = ()
    motorway: Sequence[str] = ()
    foot: Sequence[str] = ()
    area: Sequence[str] = ("yes",)
    bicycle_denied: Sequence[str] = ("no",)
    bicycle_allowed: Sequence[str] = ("yes", "designated")
    access_private: Sequence[str] = ("private", "no")
    service_private: Sequence[str] = ()
    forward: Sequence[str] = ("yes", "true", "1")
    backward: Sequence[str] = ("-1", "reverse")
    opposite_cycleway: Sequence[str] = ("opposite", "opposite_lane", "opposite_track")


def _in(tags: Column, key: str, values: Sequence[str]) -> Column:
    """Whether a tag has one of the values; false where it is absent."""
    return F.coalesce(tags[key].isin(list(values)), F.lit(False)) if values else F.lit(False)


def accessible(tags: Column, r: AccessRules) -> Column:
    """Whether bicycles may use a way: an explicit permission opens private ways, motorways and footways, a denial closes any."""
    open_ = _in(tags, "bicycle", r.bicycle_allowed)
    closed = _in(tags, "highway", r.never) | _in(tags, "area", r.area) | _in(tags, "bicycle", r.bicycle_denied) | (_in(tags, "access", r.access_private) & ~open_)
    asks = _in(tags, "highway", r.motorway) | _in(tags, "highway", r.foot)
    service = (F.coalesce(tags["highway"], F.lit("")) == "service") & _in(tags, "service", r.service_private)
    return (F.coalesce(tags["highway"], F.lit("")) != "") & ~closed & F.when(asks, open_).otherwise(~service)


def direction_sign(tags: Column, r: AccessRules) -> Column:
    """1 for ways open forward only, -1 for backward only, 0 for both."""
    return F.when(_in(tags, "oneway", r.forward), 1).when(_in(tags, "oneway", r.backward), -1).otherwise(0)


def both_ways(tags: Column, r: AccessRules) -> Column:
    return (F.coalesce(tags["oneway:bicycle"], F.lit("")) == "no") | _in(tags, "cycleway", r.opposite_cycleway)


def classify(tags: Column, rules: Sequence[tuple[str, Sequence[tuple[str, Sequence[str]]]]]) -> Column:
    """Struct (category, matched) of the first rule that a tag meets; a rule without values takes any that is not empty. Null if none."""
    out = F.lit(None).cast("struct<category:string,matched:string>")
    flat = [(category, key, values) for category, tests in rules for key, values in tests]
    for category, key, values in reversed(flat):
        v = tags[key]
        hit = _in(tags, key, values) if values else F.coalesce(v != "", F.lit(False))
        out = F.when(hit, F.struct(F.lit(category).alias("category"), F.concat(F.lit(f"{key}="), v).alias("matched"))).otherwise(out)
    return out


def build_network(ways: DataFrame, nodes: DataFrame, r: AccessRules) -> tuple[DataFrame, DataFrame]:
    """(segments, edges) of ways (osmid, tags, refs) over nodes (id, x, y).

    A way is cut at inner nodes that several ways use. Each segment gives two
    directed edges, 2 * segment and 2 * segment + 1; the illegal one is kept and
    marked. Segments are numbered in order of way and place: counts of ranges of
    ways go before the places within a range, so no window holds all segments.
    """
    at = ways.select("osmid", "tags", F.posexplode("refs").alias("i", "id"), (F.size("refs") - 1).alias("end"))
    uses = at.groupBy("id").agg(F.count_distinct("osmid").alias("uses"))
    p = at.join(uses, "id").join(nodes.select("id", "x", "y"), "id")
    w = Window.partitionBy("osmid").orderBy("i")
    cut = (F.col("i") > 0) & (F.col("i") < F.col("end")) & (F.col("uses") > 1)
    p = p.withColumn("piece", F.coalesce(F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    p = p.withColumns({"step": step, "prev": F.struct(F.lag("id").over(w).alias("id"), F.lag("x").over(w).alias("x"), F.lag("y").over(w).alias("y")), "has_prev": F.lag("id").over(w).isNotNull()})
    rows = F.sort_array(F.collect_list(F.struct("i", "id", "x", "y", "prev", "step")))
    g = p.where("has_prev").groupBy("osmid", "piece").agg(rows.alias("r"), F.sum("step").alias("length_m"), F.first("tags").alias("tags")).where("length_m > 0")
    first, last = F.col("r")[0]["prev"], F.element_at("r", -1)
    line = F.concat(F.array(F.struct(first["x"].alias("x"), first["y"].alias("y"))), F.transform("r", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    g = g.withColumn("range", F.floor(F.col("osmid") / RANGE))
    before = g.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    g = g.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy("osmid", "piece")) - 1).join(before, "range")
    segments = g.select((F.col("before") + F.col("own")).cast("long").alias("segment_id"), "osmid", F.coalesce(F.col("tags")["highway"], F.lit("")).alias("highway"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), "length_m", line.alias("line"), first["id"].alias("u"), last["id"].alias("v"), direction_sign(F.col("tags"), r).alias("sign"), both_ways(F.col("tags"), r).alias("both"))
    edges = segments.withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1))))
    back = F.col("direction") == 1
    edges = edges.select((F.col("segment_id") * 2 + F.col("direction")).alias("edge_index"), "segment_id", "direction", F.when(back, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(back, F.col("u")).otherwise(F.col("v")).alias("v"), "highway", "name", "length_m", (F.col("both") | F.when(back, F.col("sign") != 1).otherwise(F.col("sign") != -1)).alias("is_legal_direction"))
    return segments.drop("u", "v", "sign", "both"), edges
