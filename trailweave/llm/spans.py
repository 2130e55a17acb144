"""Cutting byte spans out of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal ones."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def named(docs: DataFrame, rest: list[str]) -> DataFrame:
    """doc_id, text, and the other columns as c0, c1, ..."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])


def keyed(docs: DataFrame, rest: list[str]) -> DataFrame:
    """``named`` columns and ``key``: 64 bits of the id and the SHA-256 of the text. Only rows equal in both share a key: another salt is taken until no two others do."""
    frame = named(docs, rest)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    salt = 0
    while True:
        key = F.xxhash64(F.lit(salt), "doc_id", sha).alias("key")
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", sha.alias("sha"))
        clash = frame.select(key, row.alias("row")).groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b")
        if clash.isEmpty():
            return frame.select(key, *frame.columns)
        salt += 1


def others(docs: DataFrame, text_out: bool) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text", *MADE)] if text_out else []


def cut_out(frame: DataFrame, spans: DataFrame, rest: list[str], text_out: bool) -> DataFrame:
    """Texts of a frame without the spans (key, from, till: arrays of half-open byte bounds), with sizes and a digest of what is kept. Only texts and bounds go through Python, so other columns keep their types and nulls."""

    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string" + (",text:string>" if text_out else ">"))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, froms, tills in batches:
            rows = []
            for text, starts, ends in zip(texts, froms, tills, strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                a, b = merge(np.asarray(starts), np.asarray(ends)) if starts is not None else ([], [])
                kept = b"".join([raw[i:j] for i, j in zip([0, *b], [*a, len(raw)], strict=True)])
                rows.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), *((text if not len(a) else kept.decode("utf-8", "ignore"),) if text_out else ())))
            yield pd.DataFrame(rows, columns=[*MADE, *(["text"] if text_out else [])])

    made = [*MADE, *(["text"] if text_out else [])]
    columns = [f"c{i}" for i in range(len(rest))]
    done = frame.join(spans, "key", "left").select("doc_id", *columns, cut.asNondeterministic()("text", "from", "till").alias("made"))
    return done.select("doc_id", *[F.col(f"made.{c}").alias(c) for c in made], *[F.col(c).alias(name) for c, name in zip(columns, rest, strict=True)])
