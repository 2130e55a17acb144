"""Reading staged CSV files, dated Parquet tables and small configuration files."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterable, Sequence
from datetime import date
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("source_row", T.LongType()), T.StructField("BICYCLE_ID", T.StringType()), T.StructField("LOCATING_TIME", T.StringType()), T.StructField("LATITUDE", T.DoubleType()), T.StructField("LONGITUDE", T.DoubleType())])
ORDERS = T.StructType([T.StructField("source_row", T.LongType()), T.StructField("BICYCLE_ID", T.StringType()), T.StructField("LATITUDE", T.DoubleType()), T.StructField("LONGITUDE", T.DoubleType()), T.StructField("LOCK_STATUS", T.IntegerType()), T.StructField("UPDATE_TIME1", T.StringType()), T.StructField("UPDATE_TIME2", T.StringType()), T.StructField("ORDER DURATION", T.DoubleType())])


class InputError(Exception):
    """One or more inputs cannot be used; the message lists all problems."""


def date_in_filename(path: str | Path) -> date:
    """The date in a file name that holds exactly one run of eight digits."""
    found = re.findall(r"(?<!\d)\d{8}(?!\d)", Path(path).name)
    if len(found) != 1:
        raise InputError(f"{path}: expected one date, found {len(found)}")
    try:
        return date(int(found[0][:4]), int(found[0][4:6]), int(found[0][6:]))
    except ValueError as e:
        raise InputError(f"{path}: {e}") from e


def header_problem(path: str | Path, schema: T.StructType) -> str | None:
    """What is wrong with a CSV header, which Spark would bind by position; None if nothing."""
    with open(path, newline="", encoding="utf-8-sig") as f:
        header = next(csv.reader(f), None)
    if header is None:
        return f"{path}: no header"
    return None if header == schema.fieldNames() else f"{path}: header is {header}, expected {schema.fieldNames()}"


def resolve_inputs(folder: str | Path, dates: Iterable[date], schema: T.StructType = POINTS) -> dict[date, Path]:
    """The one CSV of each date; every problem is named at once."""
    by: dict[date, list[Path]] = {}
    problems = []
    for p in sorted(Path(folder).glob("*.csv")):
        try:
            by.setdefault(date_in_filename(p), []).append(p)
        except InputError as e:
            problems.append(str(e))
    out = {}
    for d in sorted(set(dates)):
        if len(by.get(d, [])) != 1:
            problems.append(f"{d}: {len(by.get(d, []))} files")
        elif wrong := header_problem(by[d][0], schema):
            problems.append(wrong)
        else:
            out[d] = by[d][0]
    if problems:
        raise InputError("; ".join(problems))
    return out


def resolve_single(folder: str | Path, preferred: str = "orders.csv") -> Path:
    """The only CSV of a folder, or the preferred one among several."""
    found = sorted(Path(folder).glob("*.csv"))
    if len(found) == 1:
        return found[0]
    for p in found:
        if p.name == preferred:
            return p
    raise InputError(f"{folder}: {len(found)} CSV files and no {preferred}")


def read_points(spark: SparkSession, path: str, day: date) -> DataFrame:
    """A day's points with a timestamp from its date and the time of day in the text."""
    raw = spark.read.schema(POINTS).option("header", True).option("enforceSchema", False).csv(path)
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", F.lit(day.isoformat()), F.trim("LOCATING_TIME")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return raw.select("source_row", F.col("BICYCLE_ID").alias("entity"), stamp.alias("ts"), F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"), F.lit(day).alias("source_date"))


def read_lock_events(spark: SparkSession, path: str) -> DataFrame:
    """Lock events with a timestamp from two text columns."""
    raw = spark.read.schema(ORDERS).option("header", True).option("enforceSchema", False).csv(path)
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", F.trim("UPDATE_TIME1"), F.trim("UPDATE_TIME2")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return raw.select("source_row", F.col("BICYCLE_ID").alias("entity"), stamp.alias("ts"), F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"), F.col("LOCK_STATUS").alias("status"))


def union_days(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_dated(spark: SparkSession, path: str, dates: Sequence[date], column: str = "source_date", schema: T.StructType | None = None) -> DataFrame:
    """Partitions of some dates only; with a schema that says ``date`` the filter prunes folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.withColumn(column, F.col(column).cast("date")).where(F.col(column).isin([d for d in dates])) if schema is None else df.where(F.col(column).isin([d for d in dates]))


def read_subset(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a table; InputError if some are missing."""
    df = spark.read.parquet(path)
    if missing := sorted(set(columns) - set(df.columns)):
        raise InputError(f"{path}: no columns {missing}")
    return df.select(*columns)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """A table that must not be empty."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise InputError(f"{path}: empty")
    return df


def read_rings(path: str | Path) -> list[list[list[tuple[float, float]]]]:
    """Polygons (outer ring, then holes) of a GeoJSON file of polygons or multi-polygons."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    shapes = [f["geometry"] for f in doc["features"]] if doc.get("type") == "FeatureCollection" else [doc.get("geometry", doc)]
    out = []
    for s in shapes:
        if s.get("type") not in ("Polygon", "MultiPolygon"):
            raise InputError(f"{path}: {s.get('type')} is no polygon")
        for polygon in [s["coordinates"]] if s["type"] == "Polygon" else s["coordinates"]:
            rings = [[(float(x), float(y)) for x, y, *_ in ring] for ring in polygon]
            if any(len(r) < 4 or r[0] != r[-1] for r in rings):
                raise InputError(f"{path}: a ring is not closed")
            out.append(rings)
    if not out:
        raise InputError(f"{path}: no polygon")
    return out


def read_labels(path: str | Path, digest: str) -> dict[int, str]:
    """Labels by id, valid only for the partition with that digest."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    if doc.get("region_cells_digest") != digest:
        raise InputError(f"{path}: labels belong to another partition")
    return {int(k): str(v) for k, v in doc["labels"].items()}


def stage_workbook(source: str | Path, target: str | Path) -> int:
    """An Excel workbook as UTF-8 CSV with a source_row column in front; rows written. Needs an Excel reader for pandas."""
    import pandas as pd

    try:
        sheet = pd.read_excel(source)
    except ImportError as e:
        raise InputError("no Excel reader is installed") from e
    sheet.insert(0, "source_row", range(1, len(sheet) + 1))
    sheet.to_csv(target, index=False, encoding="utf-8")
    return len(sheet)
