"""Paths on a square grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("int")


def _cuts(a: Column, b: Column, size: float) -> Column:
    """Parameters in (0, 1) at which the way from a to b meets a grid line."""
    low, high = F.floor(F.least(a, b) / size) + 1, F.floor(F.greatest(a, b) / size)
    lines = F.when((a != b) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(lines, lambda k: (k * F.lit(size) - a) / (b - a))


def traverse(points: DataFrame, key: Sequence[str], order: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Exact crossings of each polyline: key, run_index, cell_x, cell_y, length_m, entry and exit.

    A leg is cut at every grid line; a stretch belongs to the cell of its middle.
    Where two stretches meet in a corner, cells of length 0 step across, along x
    first and then along y, so that neighbours always share an edge. Neighbouring
    stretches in one cell are merged.
    """
    w = Window.partitionBy(*key).orderBy(order)
    legs = points.select(*key, F.row_number().over(w).alias("__leg"), F.lag(x).over(w).alias("__x0"), F.lag(y).over(w).alias("__y0"), F.col(x).alias("__x1"), F.col(y).alias("__y1"))
    legs = legs.where("__x0 is not null and (__x0 <> __x1 or __y0 <> __y1)")
    ends = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0.0), F.lit(1.0)), _cuts(F.col("__x0"), F.col("__x1"), size), _cuts(F.col("__y0"), F.col("__y1"), size)), lambda t: (t >= 0) & (t <= 1))))
    legs = legs.withColumn("__cut", ends)
    parts = legs.select("*", F.posexplode(F.arrays_zip(F.slice("__cut", 1, F.size("__cut") - 1).alias("a"), F.slice("__cut", 2, F.size("__cut")).alias("b"))).alias("__part", "__ab"))
    a, b, mid = F.col("__ab.a"), F.col("__ab.b"), (F.col("__ab.a") + F.col("__ab.b")) / 2
    dx, dy = F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0")
    parts = parts.where(b - a > EPS).select(*key, "__leg", "__part", cell(F.col("__x0") + mid * dx, size).alias("cell_x"), cell(F.col("__y0") + mid * dy, size).alias("cell_y"), ((b - a) * F.sqrt(dx * dx + dy * dy)).alias("length_m"), (F.col("__x0") + a * dx).alias("entry_x"), (F.col("__y0") + a * dy).alias("entry_y"), (F.col("__x0") + b * dx).alias("exit_x"), (F.col("__y0") + b * dy).alias("exit_y"))
    w = Window.partitionBy(*key).orderBy("__leg", "__part")
    parts = parts.withColumns({"__px": F.lag("cell_x").over(w), "__py": F.lag("cell_y").over(w)})
    sx, sy = F.signum(F.col("cell_x") - F.col("__px")).cast("int"), F.signum(F.col("cell_y") - F.col("__py")).cast("int")
    along_x = F.when(F.col("__px") != F.col("cell_x"), F.transform(F.sequence(F.col("__px") + sx, F.col("cell_x"), F.when(sx == 0, 1).otherwise(sx)), lambda v: F.struct(v.cast("int").alias("x"), F.col("__py").alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    along_y = F.when(F.col("__py") != F.col("cell_y"), F.transform(F.sequence(F.col("__py") + sy, F.col("cell_y"), F.when(sy == 0, 1).otherwise(sy)), lambda v: F.struct(F.col("cell_x").alias("x"), v.cast("int").alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    steps = F.filter(F.coalesce(F.concat(along_x, along_y), F.array().cast("array<struct<x:int,y:int>>")), lambda c: (c["x"] != F.col("cell_x")) | (c["y"] != F.col("cell_y")))
    way = F.concat(F.transform(steps, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.lit(0.0).alias("len"), F.col("entry_x").alias("ox"), F.col("entry_y").alias("oy"))), F.array(F.struct(F.col("cell_x").alias("x"), F.col("cell_y").alias("y"), F.col("length_m").alias("len"), F.col("exit_x").alias("ox"), F.col("exit_y").alias("oy"))))
    rows = parts.select(*key, "__leg", "__part", "entry_x", "entry_y", F.posexplode(way).alias("__step", "c"))
    w = Window.partitionBy(*key).orderBy("__leg", "__part", "__step")
    fresh = F.lag("c.x").over(w).isNull() | (F.lag("c.x").over(w) != F.col("c.x")) | (F.lag("c.y").over(w) != F.col("c.y"))
    rows = rows.withColumn("__new", fresh.cast("int")).withColumn("run_index", (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    at = F.struct("__leg", "__part", "__step")
    return rows.groupBy(*key, "run_index").agg(F.first("c.x").alias("cell_x"), F.first("c.y").alias("cell_y"), F.sum("c.len").alias("length_m"), F.min_by("entry_x", at).alias("entry_x"), F.min_by("entry_y", at).alias("entry_y"), F.max_by("c.ox", at).alias("exit_x"), F.max_by("c.oy", at).alias("exit_y"))


def cell_links(crossings: DataFrame, day: str, track: Sequence[str], piece: Sequence[str] = ()) -> DataFrame:
    """Directed links between neighbouring cells of a path: day, from, to, and the tracks that use it (each counts once for a link and day)."""
    w = Window.partitionBy(*track, *piece).orderBy("run_index")
    moves = crossings.select(F.col(day), *track, F.lag("cell_x").over(w).alias("from_x"), F.lag("cell_y").over(w).alias("from_y"), F.col("cell_x").alias("to_x"), F.col("cell_y").alias("to_y")).where("from_x is not null")
    return moves.dropDuplicates([day, *track, "from_x", "from_y", "to_x", "to_y"]).groupBy(day, "from_x", "from_y", "to_x", "to_y").agg(F.count("*").alias("tracks"))


def linked_cells(links: DataFrame) -> DataFrame:
    return links.select(F.col("from_x").alias("cell_x"), F.col("from_y").alias("cell_y")).union(links.select("to_x", "to_y")).distinct()


def rook_neighbours(cells: DataFrame, x: str = "cell_x", y: str = "cell_y") -> DataFrame:
    """Each cell with its right and upper neighbour: every edge of the grid once."""
    step = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    return cells.select("*", step.alias("__s")).withColumns({"next_x": F.col(x) + F.col("__s.dx"), "next_y": F.col(y) + F.col("__s.dy")}).drop("__s")


def region_adjacency(cells: DataFrame, region: str) -> DataFrame:
    """Pairs a < b of regions that share an edge of a cell."""
    other = cells.select(F.col("cell_x").alias("next_x"), F.col("cell_y").alias("next_y"), F.col(region).alias("__b"))
    pairs = rook_neighbours(cells).join(other, ["next_x", "next_y"]).where(F.col(region) != F.col("__b"))
    return pairs.select(F.least(region, "__b").alias("a"), F.greatest(region, "__b").alias("b")).distinct()


def min_cells(size: float, base: int = 14, base_size: float = 150.0) -> int:
    """The floor of a component's cells for another cell size, rounded half to even."""
    return round(base * (base_size / size) ** 2)
