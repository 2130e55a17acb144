"""Intermediate tables in the folder that the cluster shares.

A table written here survives the loss of any executor: later stages read it
back instead of recomputing, and the lineage ends at the files.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of texts that pass to a Python worker at once; texts can be long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows that a Parquet reader decodes at once, and bytes that it reads into one buffer: with long texts the usual 4096 rows and 8 MB make arrays so large that the heap keeps them apart and grows.
READ_ROWS, READ_BYTES = 512, 256 << 10
#: Bytes that a writer of an intermediate table holds before it writes a row group.
GROUP_BYTES = 16 << 20


def lower(spark: SparkSession) -> None:
    """Lower the session's batches to the bounds above, so that the memory of an executor and its workers doesn't depend on the length of texts."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    conf.set("parquet.read.allocation.size", str(READ_BYTES))


def quiet(spark: SparkSession) -> SparkSession:
    """A copy of the session, with its settings, whose batches are lowered. The caller's session stays as it is."""
    if spark.__dict__.get("_quiet"):
        return spark
    spark = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    spark.__dict__["_quiet"] = True
    lower(spark)
    return spark


def adopt(df: DataFrame, own: SparkSession | None = None) -> DataFrame:
    """The same rows, run with the settings of a ``quiet`` session, or of the given one. A file is still read with the settings of the session that opened it."""
    own = own or quiet(df.sparkSession)
    if own is df.sparkSession:
        return df
    plan = df._jdf.queryExecution().logical()
    return DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, plan), own)


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, one of our own, but only if the driver runs all tasks itself: executors elsewhere would not see it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir names no folder that driver and executors share, and the master is {master}")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='trailweave-')}")


class Scratch:
    """Tables of one operator call, each dropped as soon as nothing reads it. Those that a result still reads go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.live: list[str] = []

    def passing(self) -> str:
        """The folder of these tables, which goes when the application ends."""
        root, fs = self._path(self.root)
        fs.deleteOnExit(root)
        return self.root

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and read it again. Snappy, since Zstandard's buffers outside the heap wait for its garbage collection."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.option("compression", codec).option("parquet.block.size", GROUP_BYTES).mode("overwrite").parquet(path)
        if self.n == 1:
            self.passing()
        self.live.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_scratch_path"] = path
        return out

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more. Spark deletes the shuffle files of a finished job once the driver has collected its objects, so the driver is asked to."""
        for df in frames:
            self.live.remove(df.__dict__["_scratch_path"])
            path, fs = self._path(df.__dict__["_scratch_path"])
            fs.delete(path, True)
        self.collect()

    def only(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        wanted = [df.__dict__["_scratch_path"] for df in frames]
        gone = [p for p in self.live if p not in wanted]
        for p in gone:
            path, fs = self._path(p)
            fs.delete(path, True)
        self.live = [p for p in self.live if p in wanted]
        if gone:
            self.collect()

    def collect(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return quiet(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
