"""Names of roads for regions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dominant_names(weights: DataFrame, by: Sequence[str], count: int = 2) -> DataFrame:
    """The first ``count`` names of each group: ``names`` (array, empty texts at the end). ``weights`` has by, name, rank, weight.

    Weights of a name in a rank are summed; names go by rank, then weight from
    large to small, then name. Where a name with ideographs exists, names without
    any are left out. A name counts once, at its best place; empty names never.
    """
    named = weights.where("name <> ''").groupBy(*by, "rank", "name").agg(F.sum("weight").alias("weight"))
    own = F.col("name").rlike("[\u4e00-\u9fff]")
    named = named.withColumn("__own", own).withColumn("__some", F.bool_or("__own").over(Window.partitionBy(*by))).where("__own or not __some")
    best = named.groupBy(*by, "name").agg(F.min(F.struct("rank", (-F.col("weight")).alias("w"))).alias("__at"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__at", "name"))
    top = best.withColumn("__k", place).where(F.col("__k") <= count).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "name"))), lambda s: s["name"]).alias("names"))
    return top.withColumn("names", F.concat("names", F.array_repeat(F.lit(""), F.lit(count) - F.size("names"))))


def midpoints(segments: DataFrame) -> DataFrame:
    """Segments with mid_x and mid_y: the place half of the way along their line."""

    def run(batches):
        for pdf in batches:
            mid = []
            for line in pdf["line"]:
                p = np.array([(v["x"], v["y"]) for v in line], float)
                at = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
                mid.append((float(np.interp(at[-1] / 2, at, p[:, 0])), float(np.interp(at[-1] / 2, at, p[:, 1]))))
            yield pd.DataFrame({"segment_id": pdf["segment_id"], "mid_x": [m[0] for m in mid], "mid_y": [m[1] for m in mid]})

    found = segments.select("segment_id", "line").mapInPandas(run, "segment_id long, mid_x double, mid_y double")
    return segments.join(found, "segment_id")


def road_names(segments: DataFrame, cells: DataFrame, size: float, ranks: Sequence[str], count: int = 2) -> DataFrame:
    """Names of the main roads of each region of ``cells`` (cell_x, cell_y, region and any group columns): a segment belongs to the region of the cell of its middle, with its length as weight and the place of its kind in ``ranks`` as rank."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("highway")), F.lit(0))
    rows = midpoints(segments).select(F.coalesce("name", F.lit("")).alias("name"), F.when(rank > 0, rank - 1).otherwise(len(ranks)).cast("int").alias("rank"), F.col("length_m").alias("weight"), F.floor(F.col("mid_x") / size).cast("int").alias("cell_x"), F.floor(F.col("mid_y") / size).cast("int").alias("cell_y"))
    return dominant_names(rows.join(cells, ["cell_x", "cell_y"]), ["region"], count)
