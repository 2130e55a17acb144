"""Repeated byte strings: suffixes ordered only through ``width`` bytes.

A sort of every suffix by its leading digits writes a row of 16 bytes for each
byte of text in its first pass alone, 16 times the input, which no disk budget
of a few times the input holds. So the passes here are no plain radix sort by
leading bytes; they refine groups of suffixes by more and more of their string,
and a group of one leaves at once:

1. The smallest hash among the 64-byte strings of a window is the window's
   anchor, and neighbouring windows with the same anchor form a run. Equal
   windows have equal anchors, so a run whose anchor's string is found once is
   done, and a fiftieth of the suffixes takes part.
2. The whole string under a run: equal runs are repeated in full. What is left,
   and one of each group of equal runs with the same anchor, goes on.
3. The 185 bytes that 16 neighbouring windows share, with the whole string
   under all 16 settled first as in pass 2.
4. The window itself.

After the last pass equal groups are exactly the repeated windows. Rolling
hashes of 64 bits only ever keep a candidate; runs, stretches and windows count
as equal by their BLAKE2b digests of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import Rolling, digests, sliding_min
from .scratch import Scratch, adopt, table
from .spans import cut_out, keyed, others

#: Bytes of an anchor's string, windows of one third digit, and starts handled at once.
GRAM, STRIDE, CHUNK = 64, 16, 1 << 19
_LOW = np.uint64((1 << 20) - 1)

_ANCHOR, _CORE = Rolling(101), Rolling(202)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def find_runs(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with a common anchor: (hash of the anchor's string, digest of the run's string, first start, number of starts, anchor minus first start)."""
    parts: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(0, len(data) - width + 1), CHUNK):
        piece = data[base : base + CHUNK + width - 1]
        grams = _ANCHOR.windows(_ANCHOR.prefix(piece), GRAM)
        best = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), width - GRAM + 1)
        anchor = (best & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(first, len(anchor)))
        at = anchor[first]
        parts.append((grams[at], digests(piece, first, first + n + (width - 1)), base + first, n, at - first))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.reshape(0, 2), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                some = pdf.iloc[a : a + 500]
                found = [find_runs(_bytes(t), width) for t in some["text"]]
                sizes = [len(f[0]) for f in found]
                anchor, string, start, n, back = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "s1": string[:, 0], "s2": string[:, 1], "key": np.repeat(some["key"].to_numpy(), sizes), "place": start << 20 | (n - 1) << 10 | back})

    return run


def _start(place):
    return F.shiftright(place, 20)


def _count(place):
    return (F.shiftright(place, 10).bitwiseAND(F.lit(1023)) + 1)


def _fetch(width: int):
    """The bytes under each run of a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, places in zip(pdf["key"].tolist(), pdf["text"], pdf["places"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for p in np.asarray(places).tolist():
                    s, n = p >> 20, (p >> 10 & 1023) + 1
                    rows.append((key, p, raw[s : s + n - 1 + width]))
                if len(rows) > 20000:
                    yield pd.DataFrame(rows, columns=["key", "place", "bytes"])
                    rows = []
            yield pd.DataFrame(rows, columns=["key", "place", "bytes"])

    return run


def _cores(width: int):
    """Third pass: for each stretch of STRIDE offsets from the anchor, the hash of what its windows share, and the digest of all bytes under them where the run holds the whole stretch (else both halves are null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            core, full, whole, key, digit = [], [], [], [], []
            for tkey, place, raw in zip(pdf["tkey"].tolist(), pdf["place"].tolist(), pdf["bytes"], strict=True):
                n, back = (place >> 10 & 1023) + 1, place & 1023
                js = np.arange((back - n + 1) // STRIDE, back // STRIDE + 1)
                low, high = back - STRIDE * js, back - STRIDE * js - (STRIDE - 1) + width
                core.append(_CORE.span(_CORE.prefix(np.frombuffer(raw, np.uint8)), low, high) ^ js.astype(np.uint64))
                inside = (STRIDE * js >= back - n + 1) & (STRIDE * js + STRIDE - 1 <= back)
                found = np.zeros((len(js), 2), np.int64)
                found[inside] = digests(raw, low[inside] - (STRIDE - 1), low[inside] + width)
                full.append(found)
                whole.append(inside)
                key.append(np.full(len(js), tkey))
                digit.append(js)
            if core:
                both, some = np.concatenate(full), np.concatenate(whole)
                halves = [pd.array(both[:, i], "Int64") for i in (0, 1)]
                for h in halves:
                    h[~some] = pd.NA
                yield pd.DataFrame({"core": np.concatenate(core).view(np.int64), "f1": halves[0], "f2": halves[1], "tkey": np.concatenate(key), "digit": np.concatenate(digit).astype(np.int32)})

    return run


def _windows(width: int):
    """Fourth pass: the windows of the stretches that were met again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, place, raw, digits in zip(pdf["key"].tolist(), pdf["place"].tolist(), pdf["bytes"], pdf["digits"], strict=True):
                s, n, back = place >> 20, (place >> 10 & 1023) + 1, place & 1023
                starts = np.arange(n)
                starts = starts[np.isin((back - starts) // STRIDE, np.asarray(digits))]
                out.append((digests(raw, starts, starts + width), np.full(len(starts), key), s + starts))
                if len(out) >= 5000:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    def _frame(out: list) -> pd.DataFrame:
        window, key, start = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"w1": window[:, 0], "w2": window[:, 1], "key": key, "start": start})

    return run


def repeated_spans(docs: DataFrame, width: int = 200) -> DataFrame:
    """For each document (key) with repeated windows the arrays of their half-open byte spans: from, till.

    ``docs`` holds key and text; rows of one key count as copies of one document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    runs = scratch.keep(docs.where(F.octet_length("text") >= width).mapInPandas(_runs(width), "anchor long, s1 long, s2 long, key long, place long"))
    anchors = scratch.keep(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    met = scratch.keep(runs.join(anchors, "anchor"))
    scratch.drop(runs, anchors)
    string = ["anchor", "s1", "s2"]
    groups = scratch.keep(met.groupBy(*string).agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")))
    whole = met.join(groups.where("n > 1").select(*string), string).select("key", _start(F.col("place")).alias("from"), (_start(F.col("place")) + _count(F.col("place")) + (width - 1)).alias("till"))
    lone = scratch.keep(groups.where("n = 1").select("anchor").distinct())
    test = groups.where("n = 1").union(groups.where("n > 1").join(lone, "anchor", "left_semi").select(*groups.columns)).select("one.*")
    lists = test.groupBy("key").agg(F.collect_list("place").alias("places"))
    held = scratch.keep(docs.join(lists, "key").select("key", "text", "places").mapInPandas(_fetch(width), "key long, place long, bytes binary").withColumn("tkey", F.monotonically_increasing_id()))
    cores = scratch.keep(held.select("tkey", "place", "bytes").mapInPandas(_cores(width), "core long, f1 long, f2 long, tkey long, digit int"))
    settled = F.col("f1").isNotNull() & (F.col("n") > 1)
    full = ["core", "f1", "f2"]
    stretches = scratch.keep(cores.groupBy(*full).agg(F.count("*").alias("n"), F.min(F.struct("tkey", "digit")).alias("one")).withColumn("settled", settled))
    twice = scratch.keep(stretches.groupBy("core").agg(F.sum("n").alias("n"), F.bool_or(~F.col("settled")).alias("open")).where("n > 1 and open").select("core"))
    at = held.select("tkey", "key", "place")
    even = cores.join(stretches.where("settled").select(*full), full).join(at, "tkey")
    low = _start(F.col("place")) + F.col("place").bitwiseAND(F.lit(1023)) - F.col("digit") * STRIDE
    even = even.select("key", (low - (STRIDE - 1)).alias("from"), (low + width).alias("till"))
    # A stretch that no other equals, or that its run holds in part, goes on by itself; of settled ones one goes on for all.
    done = stretches.where("settled").select(*full)
    lone_stretch = cores.join(done, full, "left_anti").join(twice, "core", "left_semi").select("tkey", "digit")
    stand_in = stretches.where("settled").join(twice, "core", "left_semi").select("one.*")
    digits = lone_stretch.union(stand_in).groupBy("tkey").agg(F.collect_set("digit").alias("digits"))
    windows = scratch.keep(held.join(digits, "tkey").select("key", "place", "bytes", "digits").mapInPandas(_windows(width), "w1 long, w2 long, key long, start long"))
    even = scratch.keep(even)
    scratch.drop(lone, held, cores, stretches, twice)
    equal = scratch.keep(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"))
    single = windows.join(equal, ["w1", "w2"]).select("key", F.col("start").alias("from"), (F.col("start") + width).alias("till"))
    spans = scratch.keep(whole.unionByName(even).unionByName(single).groupBy("key").agg(F.collect_list("from").alias("from"), F.collect_list("till").alias("till")))
    scratch.drop(met, groups, even, windows, equal)
    return spans


def remove_repeats(docs: DataFrame, width: int = 200, text_out: bool = False) -> DataFrame:
    """Every document without the bytes under a ``width``-byte string that also starts elsewhere.

    Elsewhere is another place of the same document or of any other row; strings
    never cross documents and are judged on the input. A null text counts as
    empty; a null doc_id is a document like any other. Rows that repeat in full
    are copies of each other. Texts under ``width`` bytes and empty tables pass
    unchanged. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with
    ``text_out`` also all other columns of ``docs`` and the kept bytes as text,
    less the bytes of characters that were cut in two (columns named like a
    result are replaced).
    """
    docs = adopt(docs)
    rest = others(docs, text_out)
    frame = keyed(docs, rest)
    return cut_out(frame, repeated_spans(frame.select("key", "text"), width), rest, text_out)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT k, i, md5(array_slice(b, i, i + 199)) AS h FROM (SELECT k, b, unnest(range(1, CAST(octet_length(b) AS BIGINT) - 198)) AS i FROM d)
), r AS (
  SELECT h FROM w GROUP BY h HAVING count(*) > 1
), s AS (
  SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM w JOIN r USING (h)
), g AS (
  SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s
), spans AS (
  SELECT k, run, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY k, run
), cut AS (
  SELECT k, count(*) AS n, sum(z - a + 1) AS gone, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM spans GROUP BY k
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(range(0, CAST(n AS BIGINT) + 1), lambda j: array_slice(b, CASE WHEN j = 0 THEN 1 ELSE ends[j] + 1 END, CASE WHEN j = n THEN octet_length(b) ELSE starts[j + 1] - 1 END)), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN cut USING (k)
"""
