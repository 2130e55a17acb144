"""Spark session with the settings that the operators count on."""

from __future__ import annotations

import re
import subprocess
import tempfile
import uuid

from pyspark.sql import SparkSession


def java_major() -> int:
    """Major version of the Java on the path; RuntimeError if there is none."""
    try:
        said = subprocess.run(["java", "-version"], capture_output=True, text=True, timeout=60).stderr
    except FileNotFoundError as e:
        raise RuntimeError("no java on the path") from e
    m = re.search(r'version "(?:1\.)?(\d+)', said)
    if not m:
        raise RuntimeError(f"cannot read the Java version from {said[:100]!r}")
    return int(m[1])


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which driver and executors share; it goes when the application ends. Where the setting is absent, one of our own, but only if the driver runs all tasks itself."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir names no folder that driver and executors share, and the master is {master}")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='trailweave-')}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def build_session(name: str = "trailweave", time_zone: str = "UTC", master: str | None = None, event_log_dir: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, a pinned time zone, and overwrites that replace only the partitions written."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # tracks are small and dear: few bytes can be much work
        "spark.sql.session.timeZone": time_zone,
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if event_log_dir:
        settings |= {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log_dir}
    return b.config(map=settings | conf).getOrCreate()
