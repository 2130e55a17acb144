"""Quality of documents by histogram gradient-boosted trees over text statistics.

Statistics of a text come from its byte counts and word hashes. Trees are grown
level by level on histograms of binned statistics, with second-order gains of
the logistic loss, and flattened into arrays; scoring walks all rows of a batch
through a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import shingles, word_hashes
from .scratch import Scratch, adopt, table

_CLASS = np.full(256, 5, np.int8)  # 5: other marks
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[_b] = 6
    elif _c.isspace():
        _CLASS[_b] = 0
    elif _c.islower():
        _CLASS[_b] = 1
    elif _c.isupper():
        _CLASS[_b] = 2
    elif _c.isdigit():
        _CLASS[_b] = 3
    elif _c in ".,;:'\"-?()":
        _CLASS[_b] = 4

NAMES = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "punctuation", "marks", "beyond_ascii", "space", "exclamation", "bar", "star_hash_percent",
    "entropy", "word_length", "word_length_sd", "distinct_words", "top_word", "distinct_shingles", "line_length", "repeated_lines", "ended_lines", "sentence_words", "upper_per_letter", "longest_byte_run",
)


def statistics(text: str | None) -> np.ndarray:
    """The statistics named in NAMES; all 0 for a null or empty text."""
    out = np.zeros(len(NAMES), np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7) / n
    words = word_hashes(text)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = data > 32
    edge = np.flatnonzero(np.diff(inside))
    lengths = edge[1::2] - edge[::2]
    lines = [x for x in text.split("\n") if x.strip()]
    share = counts[counts > 0] / n
    w = max(1, len(words))
    top = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1)
    grams = shingles(text)
    change = np.flatnonzero(np.diff(data))
    run = int(np.diff(np.concatenate([[-1], change, [n - 1]])).max())
    ends = counts[46] + counts[33] + counts[63]
    letters = kinds[1] + kinds[2]
    out[:] = (
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[0], counts[33] / n, counts[124] / n, (counts[42] + counts[35] + counts[37] + counts[36] + counts[38]) / n,
        float(-(share * np.log2(share)).sum()), lengths.mean() if len(lengths) else 0, lengths.std() if len(lengths) else 0, len(top) / w, top.max() / w, len(np.unique(grams)) / max(1, len(grams)), np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), len(words) / max(1, int(ends)), kinds[2] / letters if letters else 0, np.log1p(run),
    )
    return out


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays; leaves point to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 4.0, penalty: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows the score is 0.5 everywhere; with one label it is the smoothed share."""
    prior = (float(y.sum()) + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if not len(y) or y.min() == y.max():
        trees = 0
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)] if trees else []
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if trees else x
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(feature))
        node = np.zeros(len(y), np.int64)  # number of each row's node within the level
        level = [len(feature)]

        def add(leaf: float) -> int:
            k = len(feature)
            for values, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, leaf)):
                values.append(v)
            return k

        add(-rate * grad.sum() / (hess.sum() + penalty))
        for _ in range(depth):
            m = len(level)
            live = node >= 0
            best = np.full(m, 1e-6)
            pick = np.full((m, 2), -1)
            sums = np.stack([np.bincount(node[live], v[live], minlength=m) for v in (grad, hess)])
            for f in range(d):
                if not len(cuts[f]):
                    continue
                key = node[live] * bins + binned[live, f]
                g, h = (np.bincount(key, v[live], minlength=m * bins).reshape(m, bins).cumsum(axis=1)[:, : len(cuts[f])] for v in (grad, hess))
                other_g, other_h = sums[0][:, None] - g, sums[1][:, None] - h
                gain = g * g / (h + penalty) + other_g * other_g / (other_h + penalty) - (sums[0] ** 2 / (sums[1] + penalty))[:, None]
                gain[(h < least) | (other_h < least)] = -1
                at = gain.argmax(axis=1)
                better = gain[np.arange(m), at] > best
                best[better] = gain[np.arange(m), at][better]
                pick[better] = np.stack([np.full(m, f), at], axis=1)[better]
            grown, after = [], np.full(len(y), -1)
            for k, (f, cut) in enumerate(pick):
                if f < 0:
                    continue
                mine = node == k
                low = mine & (binned[:, f] <= cut)
                high = mine & ~low
                own = level[k]
                feature[own], threshold[own] = int(f), float(cuts[f][cut])
                for side, rows in ((left, low), (right, high)):
                    side[own] = add(-rate * grad[rows].sum() / (hess[rows].sum() + penalty))
                    after[rows] = len(grown)
                    grown.append(side[own])
            node, level = after, grown
            if not level:
                break
        flat = [np.array(v) for v in (feature, threshold, left, right, value)]
        margin += Trees(0.0, np.zeros(0, int), *flat, depth).value[_leaf(x, roots[-1], flat, depth)]
    flat = [np.array(v) for v in (feature, threshold, left, right, value)]
    return Trees(base, np.array(roots, int), *flat, depth)


def _leaf(x: np.ndarray, root: int, flat: list[np.ndarray], depth: int) -> np.ndarray:
    at = np.full(len(x), root)
    for _ in range(depth):
        at = np.where(x[np.arange(len(x)), flat[0][at]] <= flat[1][at], flat[2][at], flat[3][at])
    return at


def held_out(doc_id):
    """Rows that no label may be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, max_labels: int = 12000, keep_text: bool = False) -> DataFrame:
    """Quality of every document: all columns of ``docs`` (text only with ``keep_text``), then held_out, score and predicted.

    Labels come from rows of ``labels`` with a doc_id and a quality of 0 or 1
    that are not held out; of more than ``max_labels`` those with the smallest
    hash of doc_id are used. A null text counts as empty. A null doc_id is not
    held out and never has a label. Without labels every score is 0.5. Repeated
    rows are scored alike; an empty table gives an empty result. Columns of
    ``docs`` named like a result are replaced.
    """
    docs = adopt(docs)
    spark = docs.sparkSession
    labels = adopt(labels, spark)
    scratch = Scratch(spark, "quality")
    made = ("held_out", "score", "predicted")
    keep = [c for c in docs.columns if c not in made and (keep_text or c != "text")]

    @F.pandas_udf("array<float>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in batches:
            yield pd.Series([statistics(t) for t in col], dtype=object)

    known = scratch.keep(docs.select(*[F.col(f"`{c}`") for c in keep], stats("text").alias("__stats")))
    model = learn(known, labels, max_labels)

    @F.pandas_udf("double")
    def score(col: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(col.to_list()).astype(np.float32)) if len(col) else np.zeros(0))

    out = known.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score("__stats"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("__stats")


def learn(known: DataFrame, labels: DataFrame, max_labels: int) -> Trees:
    """Trees from the statistics of labelled documents; at most ``max_labels`` rows of numbers reach the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = usable.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label_y")).orderBy(F.xxhash64("label_id"), "label_id", "label_y").limit(max_labels)
    rows = known.select("doc_id", "__stats").join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).orderBy(F.xxhash64("label_id"), "label_id", "label_y", F.xxhash64("__stats")).limit(max_labels)
    found = rows.select("__stats", "label_y").collect()
    x = np.array([r[0] for r in found], np.float32).reshape(-1, len(NAMES))
    return fit(x, np.array([r[1] for r in found], np.float64))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")
