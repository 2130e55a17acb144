"""Distance joins and polygon predicates on plain columns and numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of a crowded cell.
BLOCK = 1024
#: Cells or polygon vertices of a map that may be sent to every worker.
MAX_CELLS = 2_000_000


def _blocks(rows: DataFrame, radius: float, fields: Sequence[str], name: str, halo: bool) -> DataFrame:
    """Rows in cells as wide as the radius (with a halo, also in the eight around), and in blocks of about BLOCK rows of a crowded cell: bx, by and an array for each field."""
    placed = rows.withColumns({"bx": F.floor(F.col("x") / radius), "by": F.floor(F.col("y") / radius)})
    size = placed.groupBy("bx", "by").agg(F.ceil(F.count("*") / BLOCK).alias("cuts"))
    dealt = placed.join(size, ["bx", "by"]).withColumn("block", F.pmod(F.xxhash64(*fields), F.col("cuts")))
    if halo:
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
        dealt = dealt.select(*fields, "block", "bx", "by", around).withColumns({"bx": F.col("bx") + F.col("d.dx"), "by": F.col("by") + F.col("d.dy")})
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: as many tasks as the session has partitions
    held = dealt.repartition(tasks, "bx", "by").groupBy("bx", "by", "block").agg(F.collect_list(F.struct(*fields)).alias("v"))
    return held.select("bx", "by", *[F.col(f"v.{c}").alias(f"{name}_{c}") for c in fields])


def _near(places: DataFrame, rows: DataFrame, radius: float, k: int) -> DataFrame:
    """For each place (x, y) the k nearest rows (id, x, y) within the radius, ties by id: x, y, near (array of d, id in order). Each block of places of a cell meets each block of rows in and around it in an Arrow batch, and some k rows for each place leave it."""
    pairs = _blocks(places, radius, ["x", "y"], "l", False).join(_blocks(rows, radius, ["id", "x", "y"], "r", True).hint("merge"), ["bx", "by"]).drop("bx", "by")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lx, ly, ri, rx, ry in zip(*[pdf[c] for c in ("l_x", "l_y", "r_id", "r_x", "r_y")], strict=True):
                dx, dy = np.subtract.outer(lx, rx), np.subtract.outer(ly, ry)
                dx *= dx
                dy *= dy
                dx += dy
                # Squares a hair beyond the bound stay: roots decide, and ties go by id further on.
                most = radius * radius * (1 + 1e-12)
                if dx.shape[1] > k:
                    most = np.minimum(np.partition(dx, k - 1, axis=1)[:, k - 1 : k] * (1 + 1e-12), most)
                i, j = np.nonzero(dx <= most)
                d = np.sqrt(dx[i, j])
                near = d <= radius
                yield pd.DataFrame({"x": lx[i[near]], "y": ly[i[near]], "d": d[near], "id": ri[j[near]]})

    found = pairs.mapInPandas(nearest, f"x double, y double, d double, id {dict(rows.dtypes)['id']}")
    return found.groupBy("x", "y").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k).alias("near"))


def knn_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, k: int) -> DataFrame:
    """At most k right rows within the radius of each left row, nearest first, ties by id: left id, right id, distance_m, rank. With one id column for both sides a row is not its own neighbour.

    Work goes by place: rows at one place share their neighbours, and of right
    rows at one place only the k + 1 smallest ids can be anybody's. Where cells as
    wide as the radius are crowded, places that have enough neighbours within a
    quarter of it, or a sixteenth and so on, are settled there first; all others
    go on to the next wider cells, the last to the radius itself. Rows without an
    id or a finite place have no neighbours and are nobody's.
    """
    same = left_id == right_id
    other = f"near_{right_id}" if same else right_id
    placed = lambda df, id_: df.select(F.col(id_).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(F.col("id").isNotNull() & (F.abs("x") < math.inf) & (F.abs("y") < math.inf))
    a, b = placed(left, left_id), placed(right, right_id)
    nth = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    rows = b.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    open_ = a.select("x", "y").distinct()
    crowd = rows.groupBy(F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(0, math.ceil(math.log(crowd / (4 * BLOCK), 16))) if crowd > 4 * BLOCK else 0
    found = None
    for r in [radius / 4**j for j in range(min(levels, 10), -1, -1)]:
        near = _near(open_, rows, r, k + 1)
        if r < radius:
            near = near.where(F.size("near") > k)
            open_ = open_.join(near, ["x", "y"], "left_anti")
        found = near if found is None else found.union(near)
    own = F.filter("near", lambda n: n["id"] != F.col("id")) if same else F.col("near")
    out = a.join(found, ["x", "y"]).select(F.col("id").alias(left_id), F.posexplode(F.slice(own, 1, k)).alias("at", "n"))
    return out.select(left_id, F.col("n.id").alias(other), F.col("n.d").alias("distance_m"), (F.col("at") + 1).alias("rank"))


def nearest_anchor(points: DataFrame, anchors: Sequence[tuple[int, float, float]], x: str = "x", y: str = "y") -> Column:
    """Struct (d2, id) of the nearest of a few fixed anchors, ties to the smaller id; an expression, so no join at all."""
    each = [F.struct(((F.col(x) - ax) * (F.col(x) - ax) + (F.col(y) - ay) * (F.col(y) - ay)).alias("d2"), F.lit(i).alias("id")) for i, ax, ay in anchors]
    return F.array_min(F.array(*each))


def lookup_or_nearest(points: DataFrame, cells: DataFrame, size: float, key: str) -> DataFrame:
    """Region of the cell of each point, else the nearest region (ties within 1e-9 to the smaller one), and whether that fallback was used.

    A region is the union of the squares of its cells, so the nearest region is
    that of the nearest square. Regions have as many cells as the map: they are
    gathered once and sent to the workers, where points without a hit are measured
    against all squares in pieces, each exactly. More than MAX_CELLS cells are refused. A
    point without coordinates, and any point if there are no cells, has a null
    region and counts as a fallback.
    """
    finite = (F.abs("x") < math.inf) & (F.abs("y") < math.inf)
    hit = points.withColumns({f"cell_{c}": F.when(finite, F.floor(F.col(c) / size).cast("int")) for c in "xy"}).join(cells, ["cell_x", "cell_y"], "left")
    rows = cells.where("region is not null").orderBy("region", "cell_x", "cell_y").select("region", "cell_x", "cell_y").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells: cut the map first")
    table = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3)
    shared = points.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("int")
    def nearest(x: pd.Series, y: pd.Series) -> pd.Series:
        t = shared.value
        xs, ys = x.to_numpy(float), y.to_numpy(float)
        out = np.full(len(xs), -1, np.int64)
        fine = np.flatnonzero(np.isfinite(xs) & np.isfinite(ys)) if len(t) else np.zeros(0, int)
        cx, cy = (t[:, 1] + 0.5) * size, (t[:, 2] + 0.5) * size
        for a in range(0, len(fine), max(1, (1 << 21) // max(1, len(t)))):
            part = fine[a : a + max(1, (1 << 21) // max(1, len(t)))]
            dx, dy = (np.maximum(np.abs(v[part][:, None] - c) - size / 2, 0.0) for v, c in ((xs, cx), (ys, cy)))
            d = np.hypot(dx, dy)
            out[part] = (d <= d.min(axis=1, keepdims=True) + 1e-9).argmax(axis=1)  # the first of equal ones, in order of region
        region = t[:, 0] if len(t) else np.zeros(1, np.int64)
        return pd.Series(np.where(out >= 0, region[out], 0)).astype("Int32").mask(pd.Series(out < 0))

    return hit.select(key, F.when(F.col("region").isNotNull(), F.col("region")).otherwise(F.when(F.col("region").isNull(), nearest("x", "y"))).alias("region"), F.col("region").isNull().alias("is_fallback"))


def in_interval(items: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, end: str, last: str, width: float) -> DataFrame:
    """Items within half-open spans of the same key (the last span of a key is closed), joined on buckets of the given width."""
    buckets = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = items.withColumn("__b", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) < F.col(end)) | (F.col(last) & (F.col(at) <= F.col(end))))
    return placed.join(buckets, [*key, "__b"]).where(inside).drop("__b")


def ring_distance(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inside by even-odd crossings, distance to the ring) for arrays of points."""
    inside = np.zeros(len(x), bool)
    best = np.full(len(x), np.inf)
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        crosses = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        length = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length, 0, 1) if length else 0.0
        best = np.minimum(best, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return inside, best


def in_polygons(polygons: Sequence[Sequence[Sequence[tuple[float, float]]]], tolerance: float = 0.0):
    """A vectorised predicate (x, y) -> inside, or within the tolerance of an edge. Holes count as outside."""
    rings = [[np.asarray(r, float) for r in polygon] for polygon in polygons]

    @F.pandas_udf("boolean")
    def inside(x: pd.Series, y: pd.Series) -> pd.Series:
        xs, ys = x.to_numpy(float), y.to_numpy(float)
        out = np.zeros(len(xs), bool)
        for polygon in rings:
            within, near = ring_distance(xs, ys, polygon[0])
            for hole in polygon[1:]:
                in_hole, d = ring_distance(xs, ys, hole)
                within &= ~in_hole
                near = np.minimum(near, d)
            out |= within | (near <= tolerance)
        return pd.Series(out)

    return inside


def segments_meet(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments p[i] q[i] and a[j] b[j] have a point in common, ends included: a matrix."""
    side = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
    p, q, a, b = p[:, None], q[:, None], a[None], b[None]
    s1, s2, s3, s4 = side(a, b, p), side(a, b, q), side(p, q, a), side(p, q, b)
    apart = (np.minimum(p, q) > np.maximum(a, b)).any(axis=-1) | (np.maximum(p, q) < np.minimum(a, b)).any(axis=-1)
    return ~apart & (s1 * s2 <= 0) & (s3 * s4 <= 0)


def segments_cross(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether segment pq properly crosses segment ab."""
    side = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    return bool(side(a, b, p) * side(a, b, q) < 0 and side(p, q, a) * side(p, q, b) < 0)


Polygon = Sequence[Sequence[tuple[float, float]]]


def polygon_distance(x: np.ndarray, y: np.ndarray, polygon: Polygon) -> np.ndarray:
    """Distance of each point to a polygon with holes; 0 inside."""
    rings = [np.asarray(r, float) for r in polygon]
    inside, near = ring_distance(x, y, rings[0])
    for hole in rings[1:]:
        within, d = ring_distance(x, y, hole)
        inside &= ~within
        near = np.minimum(near, d)
    return np.where(inside, 0.0, near)


def nearest_polygon(polygons: Sequence[tuple[int, Polygon]]):
    """A vectorised function (x, y) -> id of the nearest polygon; of those within 1e-9 of the nearest the smallest id. Null for a point that is not finite."""
    if sum(len(r) for _, p in polygons for r in p) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} vertices: cut the map first")
    known = sorted(polygons, key=lambda p: p[0])

    @F.pandas_udf("long")
    def nearest(x: pd.Series, y: pd.Series) -> pd.Series:
        xs, ys = x.to_numpy(float), y.to_numpy(float)
        fine = np.isfinite(xs) & np.isfinite(ys)
        out = pd.Series(pd.NA, index=x.index, dtype="Int64")
        if known and fine.any():
            d = np.stack([polygon_distance(xs[fine], ys[fine], p) for _, p in known])
            out[fine] = np.array([i for i, _ in known])[(d <= d.min(axis=0) + 1e-9).argmax(axis=0)]
        return out

    return nearest


def line_inside(line: Sequence[tuple[float, float]], ring: Sequence[tuple[float, float]]) -> bool:
    """All vertices inside or on the ring and no leg crossing it."""
    pts, edge = np.asarray(line, float), np.asarray(ring, float)
    inside, near = ring_distance(pts[:, 0], pts[:, 1], edge)
    if not (inside | (near <= 1e-9)).all():
        return False
    return not any(segments_cross(p, q, a, b) for p, q in zip(pts[:-1], pts[1:], strict=True) for a, b in zip(edge[:-1], edge[1:], strict=True))


def path_inside(polygons: Sequence[Polygon], tolerance: float = 0.0):
    """A vectorised predicate (xs, ys arrays) -> the whole path lies in one of the polygons, or within the tolerance of it. Without a tolerance it is exact; with one, legs are looked at in steps of an eighth of it. Null for null."""

    @F.pandas_udf("boolean")
    def inside(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            line = np.stack([np.asarray(x, float), np.asarray(y, float)], axis=1)
            if tolerance > 0:
                legs = np.hypot(*np.diff(line, axis=0).T)
                more = [np.linspace(a, b, max(2, math.ceil(8 * n / tolerance) + 1)) for a, b, n in zip(line[:-1], line[1:], legs, strict=True)]
                dense = np.concatenate([line, *more])
                out.append(any(bool((polygon_distance(dense[:, 0], dense[:, 1], p) <= tolerance).all()) for p in polygons))
            else:
                out.append(any(line_inside(line, p[0]) and not any(_touches_inside(line, hole) for hole in p[1:]) for p in polygons))
        return pd.Series(out, dtype=object)

    return inside


def _touches_inside(line: np.ndarray, hole: Sequence[tuple[float, float]]) -> bool:
    """Whether a path enters a hole."""
    edge = np.asarray(hole, float)
    within, near = ring_distance(line[:, 0], line[:, 1], edge)
    return bool((within & (near > 1e-9)).any()) or any(segments_cross(p, q, a, b) for p, q in zip(line[:-1], line[1:], strict=True) for a, b in zip(edge[:-1], edge[1:], strict=True))


def meets_polygon(polygon: Polygon):
    """A vectorised predicate (x0, y0, x1, y1) -> the leg has a point in common with the polygon; borders belong to it."""
    rings = [np.asarray(r, float) for r in polygon]
    a, b = (np.concatenate([r[i] for r in rings for i in [s]]) for s in (slice(None, -1), slice(1, None)))

    @F.pandas_udf("boolean")
    def meets(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        p, q = (np.stack([u.to_numpy(float), v.to_numpy(float)], axis=1) for u, v in ((x0, y0), (x1, y1)))
        out = polygon_distance(p[:, 0], p[:, 1], polygon) <= 1e-9
        for i in range(0, len(p), 1000):
            out[i : i + 1000] |= segments_meet(p[i : i + 1000], q[i : i + 1000], a, b).any(axis=1)
        return pd.Series(out)

    return meets


def overlay_share(features: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of each region's cells under each category, on a raster: features (category, cell_x, cell_y), regions (region, cell_x, cell_y). Overlapping features of a category count once."""
    covered = features.select("category", "cell_x", "cell_y").distinct().join(regions, ["cell_x", "cell_y"]).groupBy("region", "category").agg(F.count("*").alias("cells"))
    total = Window.partitionBy("region")
    return covered.withColumn("share", F.col("cells") / F.sum("cells").over(total))
