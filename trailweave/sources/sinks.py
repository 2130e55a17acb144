"""Writing tables: by date, by key, sorted, or as a release that appears at once."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import unordered_digest
from .files import InputError


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def refuse_existing(spark: SparkSession, paths: Sequence[str]) -> None:
    """InputError that names every output already there."""
    if there := [p for p in paths if exists(spark, p)]:
        raise InputError("already written: " + ", ".join(there))


def write_by(df: DataFrame, path: str, columns: Sequence[str], key: str = "source_date", overwrite: bool = False, sort: Sequence[str] = ()) -> None:
    """One folder for each key. Rows of a key meet in one task and are sorted there; overwriting replaces only the keys written."""
    out = df.select(*columns).repartition(key)
    if sort:
        out = out.sortWithinPartitions(key, *sort)
    out.write.mode("overwrite" if overwrite else "errorifexists").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_sorted(df: DataFrame, path: str, order: Sequence, overwrite: bool = False) -> None:
    """A small table as one sorted file."""
    df.repartition(1).sortWithinPartitions(*order).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_json(path: str | Path, value: object) -> None:
    """A JSON file that is whole or absent."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(name, path)


def check_release(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> list[str]:
    """Problems of tables to be published: missing keys, null keys, repeated keys."""
    problems = []
    for name, df in tables.items():
        key = list(keys.get(name, []))
        if not key or set(key) - set(df.columns):
            problems.append(f"{name}: no key")
            continue
        nulls = df.where(F.greatest(*[F.col(c).isNull() for c in key], F.lit(False))).limit(1)
        if not nulls.isEmpty():
            problems.append(f"{name}: null in the key")
        if not df.groupBy(*key).count().where("count > 1").limit(1).isEmpty():
            problems.append(f"{name}: repeated key")
    return problems


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], root: str) -> str:
    """Write a release beside the current one and switch to it; the same content again changes nothing. Returns its name.

    The pointer is a small file that a rename replaces, so at every moment there is
    an old or a new release and never none (in file systems whose rename is atomic).
    """
    if problems := check_release(tables, keys):
        raise InputError("; ".join(problems))
    marks = {name: unordered_digest(df) for name, df in tables.items()}
    from hashlib import sha256

    name = sha256(json.dumps(marks, sort_keys=True).encode()).hexdigest()[:16]
    if current_release(spark, root) == name:
        return name
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{t}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    after, pointer = (jvm.org.apache.hadoop.fs.Path(f"{root}/{x}") for x in (f"next-{name}", "current"))
    out = after.getFileSystem(conf).create(after, True)
    out.writeBytes(name)
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(after, pointer, how)
    return name


def current_release(spark: SparkSession, root: str) -> str | None:
    """Name of the release that the pointer names; None before the first."""
    if not exists(spark, f"{root}/current"):
        return None
    return spark.read.text(f"{root}/current").first()["value"]


def write_run(path: str, params: object, environment: Mapping[str, object], digests: Mapping[str, object]) -> None:
    """Record of a run: its parameters, where it ran and the digests of what it wrote, as three JSON files."""
    for name, value in (("params", params), ("environment", dict(environment)), ("digests", dict(digests))):
        write_json(f"{path}/{name}.json", value)
