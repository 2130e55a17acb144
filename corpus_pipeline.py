"""A corpus from raw documents to packed sequences, stage by stage.

Each stage is one operator of ``trailweave.llm``. It takes (spark, docs, sf_dir),
works on all documents that the stage before it kept, and returns documents with
the columns of the table; the last returns packed pieces. The stages lower the
batches of the session they are given, as ``docs`` are read with its settings.
Nulls, ties and repeated rows are handled as the operators say; a column of
``documents`` may have any name, also one of an operator's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.minhash import near_duplicates
from trailweave.llm.packing import pack
from trailweave.llm.quality import score_quality
from trailweave.llm.scratch import Scratch, lower, table
from trailweave.llm.suffixes import remove_repeats


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents with all columns but doc_id and text under neutral names, so that none meets a name of an operator's result; and the names to give back."""
    names = {c: c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 5) gives label 1; the others go."""
    lower(spark)
    plain, names = _aside(docs)
    return _back(score_quality(plain, table(spark, sf_dir, "labels"), keep_text=True).where(F.col("predicted") == 1), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (operator 3): the one with the smallest doc_id; of rows that share it one with the smallest text digest."""
    lower(spark)
    return near_duplicates(docs, keep_first=True).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings (operator 10). Documents left without any text go; n_chars follows the text."""
    lower(spark)
    plain, names = _aside(docs)
    out = remove_repeats(plain, text_out=True)
    out = _back(out.where((F.col("n_removed") == 0) | (F.length("text") > 0)), names)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens (operator 6): one row for each piece."""
    lower(spark)
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

#: No stage but the first could be SQL; tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each but the last is written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.only(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
