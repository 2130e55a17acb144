"""Checks that a run makes before it starts, while it runs and before it publishes. Each returns problems as texts; none means that all is well."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_row_problem(rows: DataFrame, entity: str = "entity", order: str = "source_row") -> str | None:
    """Points before the first id belong to nobody."""
    named = F.trim(F.coalesce(entity, F.lit(""))) != ""
    r = rows.agg(F.min(order).alias("first"), F.min(F.when(named, F.col(order))).alias("named")).first()
    if r["first"] is None:
        return None
    if r["named"] is None:
        return "no row names anybody"
    return f"the first id is at row {r['named']}, after the first row {r['first']}" if r["first"] < r["named"] else None


def missing_days(spark: SparkSession, root: str, tables: Sequence[str], days: Iterable, column: str = "source_date") -> list[str]:
    """Days without a folder, of each table that a stage reads; all of them at once, before any job runs."""
    from ..sources.sinks import exists

    return [f"{t}: nothing of {d}" for t in tables for d in days if not exists(spark, f"{root}/{t}/{column}={d}")]


def file_hash(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_lock(path: str | Path, inputs: Mapping[str, str | Path]) -> None:
    """Freeze the bytes of inputs, by name."""
    Path(path).write_text(json.dumps({name: file_hash(p) for name, p in sorted(inputs.items())}, indent=1), encoding="utf-8")


def lock_problems(path: str | Path, inputs: Mapping[str, str | Path]) -> list[str]:
    """Inputs that are not the frozen bytes."""
    if not Path(path).is_file():
        return [f"no lock at {path}"]
    frozen = json.loads(Path(path).read_text(encoding="utf-8"))
    out = [f"{name}: not frozen" for name in sorted(set(inputs) - set(frozen))]
    for name in sorted(set(frozen) & set(inputs)):
        if not Path(inputs[name]).is_file():
            out.append(f"{name}: no file")
        elif file_hash(inputs[name]) != frozen[name]:
            out.append(f"{name}: other bytes than frozen")
    return out


def baseline_differences(actual: DataFrame, baseline: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that are off their baseline: keys, field, expected, tolerance, actual.

    ``baseline`` has the keys, each field and, where it may differ, <field>_tolerance
    (absolute; absent or null: none). Rows on one side only differ in all fields;
    a null actual value is not compared.
    """
    tolerance = {f: F.coalesce(F.col(f"b.{f}_tolerance").cast("double"), F.lit(0.0)) if f"{f}_tolerance" in baseline.columns else F.lit(0.0) for f in fields}
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    a, b = actual.withColumn("__there", F.lit(True)).alias("a"), baseline.withColumn("__there", F.lit(True)).alias("b")
    both = a.join(b, condition, "outer")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("double").alias("expected"), tolerance[f].alias("tolerance"), F.col(f"a.{f}").cast("double").alias("actual")) for f in fields]))
    long = both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.col("a.__there").alias("in_a"), F.col("b.__there").alias("in_b"), rows.alias("r")).select(*keys, "in_a", "in_b", "r.*")
    off = F.col("in_a").isNull() | F.col("in_b").isNull() | (F.col("actual").isNotNull() & (F.col("expected").isNull() | (F.abs(F.col("actual") - F.col("expected")) > F.col("tolerance"))))
    return long.where(off).drop("in_a", "in_b")


def density_problems(metrics: DataFrame, regions: DataFrame, slots: int) -> list[str]:
    """A metric table has each region ``slots`` times, and no other."""
    per = regions.select("region").join(metrics.groupBy("region").agg(F.count("*").alias("n")), "region", "outer").join(regions.select("region", F.lit(True).alias("known")), "region", "left")
    bad = per.where(F.col("known").isNull() | (F.coalesce("n", F.lit(0)) != slots)).orderBy("region").limit(100).collect()
    return [f"region {r['region']}: {r['n'] or 0} rows instead of {slots}" if r["known"] else f"region {r['region']} is not known" for r in bad]


def member_problems(groups: DataFrame, members: DataFrame, key: str, count: str) -> list[str]:
    """Groups whose recorded number of members is another than they have."""
    own = members.groupBy(key).agg(F.count("*").alias("__n"))
    bad = groups.select(key, count).join(own, key, "left").where(F.col(count) != F.coalesce("__n", F.lit(0))).orderBy(key).limit(100).collect()
    return [f"{key} {r[key]}: {r[count]} recorded, {r['__n'] or 0} found" for r in bad]


def sample_problems(rows: DataFrame, manifest: DataFrame, entity: str = "entity", total: int | None = None) -> list[str]:
    """Where the rows of listed ids, ids filled forward already, differ from a frozen manifest (id, points)."""
    own = rows.groupBy(F.col(entity).alias("id")).agg(F.count("*").alias("n"))
    per = manifest.select("id", "points").join(own, "id", "left").orderBy("id").collect()
    out = [f"{r['id']}: {r['n'] or 0} points instead of {r['points']}" for r in per if (r["n"] or 0) != r["points"]]
    found = sum(r["n"] or 0 for r in per)
    return out or ([f"{found} points in all instead of {total}"] if total is not None and found != total else [])


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two tables hold the same keys, each as often."""
    return a.select(*keys).exceptAll(b.select(*keys)).isEmpty() and b.select(*keys).exceptAll(a.select(*keys)).isEmpty()


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join that must be one to one; ValueError if a key repeats on a side."""
    for name, side in (("left", a), ("right", b)):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"a key repeats on the {name}")
    return a.join(b, list(keys))


def environment(spark: SparkSession, root: str | Path = ".") -> dict[str, object]:
    """Versions and the state of the code that a run was made with."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=60, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    changed = git("status", "--porcelain")
    return {"python": platform.python_version(), "spark": spark.version, "java": spark._jvm.System.getProperty("java.version"), "commit": git("rev-parse", "HEAD"), "is_clean": None if changed is None else not changed}
