"""Substring removal by sliding spans of sentences.

From every sentence on, the shortest run of at least two sentences with at least
20 words is hashed. A sentence of 20 words or more counts as several: of each 16
neighbouring words it is cut before the one of least digest, so that a passage is
cut alike wherever it stands in a sentence. The first cut of a passage is before
one of its first 16 words and a run from there ends within 35 more, so a passage of
more than 50 words within longer sentences holds at least one whole run. All runs of all documents meet by hash; of equal runs
the one with the smallest (doc_id, row, place) is the first, and every sentence under
another one goes. Runs are equal by BLAKE2b digests of 128 bits of the digests of
their sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import digests
from .scratch import Scratch, adopt, table
from .spans import cut_out, named, others

_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True  # line feed, exclamation mark, full stop, question mark
#: End marks beyond ASCII: ideographic full stop, full-width exclamation and question marks, danda, Arabic question mark.
MARKS = [m.encode() for m in "\u3002\uff01\uff1f\u0964\u061f"]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
#: Words that are ranked together.
BLOCK = 1 << 16


def end_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of marks that end a sentence."""
    end = _END[data]
    if (data >= 0xD8).any():
        for mark in MARKS:
            n = len(mark)
            hit = np.ones(max(0, len(data) - n + 1), bool)
            for i, b in enumerate(mark):
                hit &= data[i : len(data) - n + 1 + i] == b
            for i in range(n):
                end[i : len(data) - n + 1 + i] |= hit
    return end


def word_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of words: what stands between blanks; each character from U+3000 to U+9FFF, which are written without blanks, is a word."""
    solid = ~_BLANK[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    lead = (data >= 0xE3) & (data <= 0xE9)
    if lead.any():
        own = lead.copy()
        own[1:] |= lead[:-1]
        own[2:] |= lead[:-2]
        opens[1:] |= solid[1:] & ~own[1:] & own[:-1]
        opens |= lead
    return opens


def word_ranks(data: np.ndarray, opens: np.ndarray, some: np.ndarray) -> np.ndarray:
    """First 64 bits of the MD5 digest of ``some`` of the words that begin at ``opens``: an order of words that owes nothing to where they stand. A word ends before a blank, the next word or the next sentence; an ideograph is one character."""
    following, blanks = np.append(opens[1:], len(data))[some], np.append(np.flatnonzero(_BLANK[data]), len(data))
    opens = opens[some]
    stop = np.minimum(following, blanks[np.searchsorted(blanks, opens)])
    view = memoryview(data)
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(opens), BLOCK):
        each = [md5(view[a:b]).digest()[:8] for a, b in zip(opens[i : i + BLOCK].tolist(), stop[i : i + BLOCK].tolist(), strict=True)]
        out.append(np.frombuffer(b"".join(each), ">u8").astype(np.uint64))
    return np.concatenate(out)


def cut_long(data: np.ndarray, start: np.ndarray, opens: np.ndarray, words: int) -> np.ndarray:
    """Starts of sentences, with further ones in sentences of at least ``words`` words: before the word of least rank (the last of equal ones) of each 4 / 5 ``words`` neighbours of a sentence, but for its first. Equal passages so get equal cuts wherever they stand in their sentences."""
    of = np.searchsorted(start, opens, side="right") - 1
    long = np.bincount(of, minlength=len(start))[of] >= words
    n, near = int(long.sum()), max(1, 4 * words // 5)
    if n < near:
        return start
    ranks, of, opens = word_ranks(data, opens, long), of[long], opens[long]
    windows = np.lib.stride_tricks.sliding_window_view(ranks[::-1], near)
    # argmin copies what it looks at, each word as often as there are neighbours.
    least = np.concatenate([windows[i : i + BLOCK].argmin(axis=1) for i in range(0, len(windows), BLOCK)])
    last = n - 1 - np.arange(len(least))
    at = (last - least)[of[last] == of[last - near + 1]]
    return np.union1d(start, opens[at[(at > 0) & (of[at - 1] == of[at])]])


def sentences(data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, first byte that is no blank, end after the last such byte, words) of each sentence or part of a long one; they cover the text, and sentences end after their marks."""
    end = end_bytes(data)
    start = np.concatenate([[0], np.flatnonzero(end[:-1] & ~end[1:]) + 1])
    opens = word_starts(data)
    opens[start] = ~_BLANK[data[start]]
    opens = np.flatnonzero(opens)
    start = cut_long(data, start, opens, words)
    stop = np.append(start[1:], len(data))
    blank = _BLANK[data]
    closes = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    lo, hi = np.searchsorted(opens, start), np.searchsorted(opens, stop)
    first, last = start.copy(), start.copy()
    some = np.flatnonzero(lo < hi)
    first[some] = opens[lo[some]]
    # What ends in a blank ends after its last word, which a blank closes.
    last[some] = stop[some]
    loose = some[blank[stop[some] - 1]]
    last[loose] = closes[np.searchsorted(closes, stop[loose], side="right") - 1]
    return start, first, last, hi - lo


def pieces(raw: bytes, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``size`` bytes that end after a line feed with no end mark behind it; a piece without such a line feed goes on."""
    base = 0
    while len(raw) - base > size:
        at = raw.find(b"\n", base + size)
        while 0 <= at < len(raw) - 1 and (_END[raw[at + 1]] or raw[at + 1] >= 0xD8):
            at = raw.find(b"\n", at + 1)
        if at < 0:
            break
        yield base, at + 1
        base = at + 1
    if base < len(raw):
        yield base, len(raw)


def find_spans(raw: bytes, least: int, words: int, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first byte, byte after) of the run that begins at each sentence, where there are enough sentences left. Sentences without a word are passed over. Besides numbers by sentence, memory follows the pieces of the text."""
    parts = []
    for a, b in pieces(raw, size):
        data = np.frombuffer(raw, np.uint8, b - a, a)
        start, first, last, n = sentences(data, words)
        stop = np.append(start[1:], len(data))
        real = n > 0
        parts.append((a + start[real], a + stop[real], n[real], digests(data, first[real], last[real])))
    if not parts:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, stop, n, each = (np.concatenate(x) for x in zip(*parts, strict=True))
    total = np.concatenate([[0], np.cumsum(n)])
    i = np.arange(len(n))
    j = np.maximum(np.searchsorted(total, total[:-1] + words), i + least)
    i, j = i[j <= len(n)], j[j <= len(n)]
    return digests(each.tobytes(), 16 * i, 16 * j), start[i], stop[j - 1]


def repeated_spans(docs: DataFrame, least: int, words: int) -> DataFrame:
    """For each document (key, first_by: its doc_id, text) with runs that are not the first of their kind the arrays of their byte bounds: key, from, till."""
    scratch = Scratch(docs.sparkSession, "sentences")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                some = pdf.iloc[a : a + 500]
                found = [find_spans((t or "").encode("utf-8", "surrogatepass"), least, words) for t in some["text"]]
                sizes = [len(f[0]) for f in found]
                h, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "first_by": np.repeat(some["first_by"].to_numpy(), sizes), "key": np.repeat(some["key"].to_numpy(), sizes), "place": start.astype(np.int64) << 32 | (stop - start).astype(np.int64)})

    spans = scratch.keep(docs.mapInPandas(run, "h1 long, h2 long, first_by long, key long, place long"))
    twice = scratch.keep(spans.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
    met = scratch.keep(spans.join(twice, "h1"))
    scratch.drop(spans, twice)
    firsts = scratch.keep(met.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("first_by", "key", "place")).alias("first")).where("n > 1").drop("n"))
    later = met.join(firsts, ["h1", "h2"]).where(F.struct("first_by", "key", "place") != F.col("first"))
    start = F.shiftright("place", 32)
    bounds = scratch.keep(later.groupBy("key").agg(F.collect_list(start).alias("from"), F.collect_list(start + F.col("place").bitwiseAND(F.lit((1 << 32) - 1))).alias("till")))
    scratch.drop(met, firsts)
    return bounds


def remove_repeats(docs: DataFrame, least: int = 2, words: int = 20, text_out: bool = False) -> DataFrame:
    """Every document without the sentences under a repeated run that is not the first of its kind.

    Sentences end after line feeds and after full stops, exclamation and question
    marks (also ideographic, Devanagari and Arabic ones), and one of at least
    ``words`` words is cut before the word of least digest (the last of equal
    ones) of each 4 / 5 ``words`` neighbours; blanks around parts make no difference.
    Characters from U+3000 to U+9FFF are words of their own. A null text counts
    as empty; a null doc_id sorts before all others. Every row is a document of
    its own, also of rows that repeat: the table is written once with numbers of
    its rows, which settle ties of doc_id. Texts with too few sentences or words
    and empty tables pass unchanged. Returns doc_id, n_bytes,
    n_removed, n_spans, kept_sha256; with ``text_out`` also the text that is left
    and all other columns of ``docs`` (those named like a result are replaced).
    """
    docs = adopt(docs)
    rest = others(docs, text_out)
    frame = Scratch(docs.sparkSession, "rows").keep(named(docs, rest).select(F.monotonically_increasing_id().alias("key"), "*"))
    first_by = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("first_by")
    return cut_out(frame, repeated_spans(frame.select("key", first_by, "text"), least, words), rest, text_out)


def op2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT k, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '[^.!?\n。！？।؟]+[.!?\n。！？।؟]*|[.!?\n。！？।؟]+') AS x FROM d)
), sized AS (
  SELECT k, i, s, len(regexp_extract_all(s, '[\x{3000}-\x{9FFF}]|[^ \t\r\n\x0b\x0c\x{3000}-\x{9FFF}]+')) AS words FROM a
), tokens AS (
  SELECT k, i, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS j FROM (SELECT k, i, regexp_extract_all(s, '[ \t\r\n\x0b\x0c]*(?:[\x{3000}-\x{9FFF}]|[^ \t\r\n\x0b\x0c\x{3000}-\x{9FFF}]+)[ \t\r\n\x0b\x0c]*') AS x FROM sized WHERE words >= 20)
), near AS (
  SELECT k, i, j, min(substr(md5(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, 16) || printf('%010d', 1000000000 - j)) OVER (PARTITION BY k, i ORDER BY j ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS least FROM tokens
), cuts AS (
  SELECT DISTINCT k, i, 1000000000 - CAST(substr(least, 17) AS BIGINT) AS j, 1 AS cut FROM near WHERE j >= 16
), b AS (
  SELECT k, i, 0 AS j, s FROM sized WHERE words < 20
  UNION ALL
  SELECT k, i, part, string_agg(s, '' ORDER BY j) FROM (SELECT k, i, j, s, count(cut) FILTER (WHERE j > 1) OVER (PARTITION BY k, i ORDER BY j) AS part FROM tokens LEFT JOIN cuts USING (k, i, j)) GROUP BY k, i, part
), p AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY i, j) AS n, s FROM b
), c AS (
  SELECT *, row_number() OVER w AS m, sum(words) OVER (w ROWS UNBOUNDED PRECEDING) AS total
  FROM (SELECT k, n, trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, len(regexp_extract_all(s, '[\x{3000}-\x{9FFF}]|[^ \t\r\n\x0b\x0c\x{3000}-\x{9FFF}]+')) AS words FROM p) WHERE words > 0 WINDOW w AS (PARTITION BY k ORDER BY n)
), runs AS (
  SELECT x.k, x.m, min(y.m) AS e FROM c x JOIN c y ON x.k = y.k AND y.m > x.m AND y.m <= x.m + 20 AND y.total - x.total + x.words >= 20 GROUP BY x.k, x.m
), keys AS (
  SELECT r.k, r.m, r.e, md5(string_agg(c.t, chr(31) ORDER BY c.m)) AS h FROM runs r JOIN c ON c.k = r.k AND c.m BETWEEN r.m AND r.e GROUP BY r.k, r.m, r.e
), later AS (
  SELECT k, m, e FROM (SELECT keys.*, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS FIRST, k, m) AS nth FROM keys JOIN d USING (k)) WHERE nth > 1
), gone AS (
  SELECT DISTINCT p.k, p.n FROM later l JOIN c x ON x.k = l.k AND x.m = l.m JOIN c y ON y.k = l.k AND y.m = l.e JOIN p ON p.k = l.k AND p.n BETWEEN x.n AND y.n
), parts AS (
  SELECT p.*, g.n IS NOT NULL AS out, coalesce(lag(g.n IS NOT NULL) OVER (PARTITION BY p.k ORDER BY p.n), FALSE) AS out_before FROM p LEFT JOIN gone g ON g.k = p.k AND g.n = p.n
), per AS (
  SELECT k, sum(octet_length(encode(s))) FILTER (WHERE out) AS removed, count(*) FILTER (WHERE out AND NOT out_before) AS spans, coalesce(string_agg(s, '' ORDER BY n) FILTER (WHERE NOT out), '') AS kept FROM parts GROUP BY k
)
SELECT doc_id, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (k)
"""
