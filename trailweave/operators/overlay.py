"""What lies in regions: areas of features by category, points and densities.

Regions are unions of grid cells, so a feature is cut cell by cell: features meet
cells by an equi-join, and within a cell the area that several features cover
together is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import segments_meet


def covered_area(features: Sequence[Sequence[np.ndarray]], low: tuple[float, float], high: tuple[float, float]) -> float:
    """Area of the union of features within a box. A feature is a list of closed rings, inside by even-odd crossings, so holes are rings too.

    The box is cut into slabs at every vertex, every crossing of two edges and
    every crossing of an edge with the box, so that within a slab the covered
    height is linear and its middle gives the area.
    """
    edges, of = [], []
    for k, rings in enumerate(features):
        for ring in rings:
            e = np.concatenate([ring[:-1], ring[1:]], axis=1)
            e = e[e[:, 0] != e[:, 2]]
            edges.append(np.where((e[:, 0] < e[:, 2])[:, None], e, e[:, [2, 3, 0, 1]]))
            of.append(np.full(len(e), k))
    if not edges:
        return 0.0
    e, of = np.concatenate(edges), np.concatenate(of)
    near = (e[:, 2] > low[0]) & (e[:, 0] < high[0])
    e, of = e[near], of[near]
    if not len(e):
        return 0.0
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    cuts = [np.array([low[0], high[0]]), e[:, 0], e[:, 2]]
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (base[None, :] - base[:, None]) / (slope[:, None] - slope[None, :])
        both = (cross > np.maximum.outer(e[:, 0], e[:, 0])) & (cross < np.minimum.outer(e[:, 2], e[:, 2]))
        cuts.append(cross[both])
        for y in (low[1], high[1]):
            at = (y - base) / slope
            cuts.append(at[(at > e[:, 0]) & (at < e[:, 2])])
    xs = np.unique(np.clip(np.concatenate(cuts), low[0], high[0]))
    total = 0.0
    for x0, x1 in zip(xs[:-1], xs[1:], strict=True):
        mid = (x0 + x1) / 2
        over = np.flatnonzero((e[:, 0] < mid) & (e[:, 2] > mid))
        if not len(over):
            continue
        y = slope[over] * mid + base[over]
        order = np.lexsort((y, of[over]))
        y = np.clip(y[order].reshape(-1, 2), low[1], high[1])  # closed rings cross a vertical an even number of times
        y = y[np.argsort(y[:, 0], kind="stable")]
        reach = np.maximum.accumulate(y[:, 1])
        start = np.maximum(y[:, 0], np.concatenate([[low[1]], reach[:-1]]))
        total += (x1 - x0) * float(np.maximum(reach - start, 0.0).sum())
    return total


def in_cells(features: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Features (feature_id, category, rings: array of arrays of x, y) beside every cell of a region that their bounding box meets."""
    points = F.flatten("rings")
    span = lambda c: F.sequence(F.floor(F.array_min(F.transform(points, lambda p: p[c])) / size).cast("int"), F.floor(F.array_max(F.transform(points, lambda p: p[c])) / size).cast("int"))
    placed = features.select("*", F.explode(span("x")).alias("cell_x")).select("*", F.explode(span("y")).alias("cell_y"))
    return placed.join(cells.select("cell_x", "cell_y", "region"), ["cell_x", "cell_y"])


def _rings(value) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in value]


def composition(features: DataFrame, points: DataFrame, cells: DataFrame, size: float, categories: Sequence[str], stop: str = "bus_stop") -> DataFrame:
    """One row for each region: area_<category> (union of its features), classified_area (union of all), share_<category> (of the sum of areas, null where there are none), classified_share, poi_<category>, poi_total, stops, stops_per_km2.

    ``features`` has feature_id, category, rings; ``points`` category, x, y;
    ``cells`` cell_x, cell_y, region. Points off all regions are left out. A null
    category, or one not listed, has no area; of points the ``stop`` category is
    counted by itself.
    """
    listed = list(categories)

    @F.pandas_udf("array<double>")
    def areas(kinds: pd.Series, rings: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        out = []
        for ks, rs, i, j in zip(kinds, rings, cx, cy, strict=True):
            low, high = (i * size, j * size), ((i + 1) * size, (j + 1) * size)
            shapes = [_rings(r) for r in rs]
            out.append([covered_area([s for s, k in zip(shapes, ks, strict=True) if k == c], low, high) for c in listed] + [covered_area(shapes, low, high)])
        return pd.Series(out, dtype=object)

    met = in_cells(features.where(F.col("category").isin(listed)), cells, size)
    by_cell = met.groupBy("region", "cell_x", "cell_y").agg(F.collect_list(F.struct("category", "rings")).alias("f"))
    cut = by_cell.select("region", areas("f.category", "f.rings", "cell_x", "cell_y").alias("a"))
    area = cut.groupBy("region").agg(*[F.sum(F.col("a")[i]).alias(f"area_{c}") for i, c in enumerate(listed)], F.sum(F.col("a")[len(listed)]).alias("classified_area"))
    at = points.select("category", F.floor(F.col("x") / size).cast("int").alias("cell_x"), F.floor(F.col("y") / size).cast("int").alias("cell_y")).join(cells, ["cell_x", "cell_y"])
    count = lambda c: F.count_if(F.col("category") == c)
    poi = at.groupBy("region").agg(*[count(c).alias(f"poi_{c}") for c in listed], count(stop).alias("stops"))
    out = cells.groupBy("region").agg((F.count("*") * F.lit(size * size / 1e6)).alias("area_km2")).join(area, "region", "left").join(poi, "region", "left")
    out = out.fillna(0.0, [f"area_{c}" for c in listed] + ["classified_area"]).fillna(0, [f"poi_{c}" for c in listed] + ["stops"])
    total, pois = F.lit(0.0), F.lit(0)
    for c in listed:
        total, pois = total + F.col(f"area_{c}"), pois + F.col(f"poi_{c}")
    shares = {f"share_{c}": F.when(total > 0, F.col(f"area_{c}") / total) for c in listed}
    return out.withColumns(shares | {"classified_share": F.col("classified_area") / (F.col("area_km2") * 1e6), "poi_total": pois.cast("long"), "stops_per_km2": F.col("stops") / F.col("area_km2")})


def features_meeting(features: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """feature_id of each feature that has a point in common with a cell of a region; touching counts."""

    @F.pandas_udf("boolean")
    def meets(rings: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        out = []
        for r, i, j in zip(rings, cx, cy, strict=True):
            shape = _rings(r)
            x0, y0, x1, y1 = i * size, j * size, (i + 1) * size, (j + 1) * size
            box = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)
            hit = any(bool(((p >= (x0, y0)) & (p <= (x1, y1))).all(axis=1).any()) or bool(segments_meet(p[:-1], p[1:], box[:-1], box[1:]).any()) for p in shape)
            out.append(hit or covered_area([shape], (x0, y0), (x1, y1)) > 0)
        return pd.Series(out, dtype=bool)

    return in_cells(features, cells, size).where(meets("rings", "cell_x", "cell_y")).select("feature_id").distinct()


def way_features(ways: DataFrame, nodes: DataFrame, category, size_limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(areas, points) of tagged ways (osmid, tags, refs) and nodes (id, tags, x, y): closed ways with a category are areas with one ring, tagged nodes with one are points. ``category`` is a column function of tags, such as ``network.classify``. Ways that miss a node are left out."""
    kind = category(F.col("tags"))
    closed = ways.withColumn("c", kind).where(F.col("c").isNotNull() & (F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)))
    at = closed.select("osmid", "c", F.size("refs").alias("n"), F.posexplode("refs").alias("i", "id")).join(nodes.select("id", "x", "y"), "id")
    ring = F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    areas = at.groupBy("osmid", "n").agg(F.first("c").alias("c"), ring.alias("ring")).where(F.size("ring") == F.col("n"))
    areas = areas.select(F.col("osmid").alias("feature_id"), F.col("c.category").alias("category"), F.col("c.matched").alias("matched"), F.array("ring").alias("rings"))
    points = nodes.withColumn("c", kind).where("c is not null").select(F.col("id").alias("feature_id"), F.col("c.category").alias("category"), F.col("c.matched").alias("matched"), "x", "y")
    return areas, points
