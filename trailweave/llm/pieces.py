"""SentencePiece encoding and decoding by one pass over an Aho-Corasick automaton.

The automaton of all pieces reads a text once. At each position its output links
list every piece that ends there, and each relaxes the best score at that
position. Characters that no piece covers become byte pieces. Blanks become the
mark of a word start, as the model has it, with one mark before the text. No
piece of the model crosses from a word into the next mark, so the best path of
a text is made of the best paths of its words; each worker keeps those it has met.

A model of log-probabilities is used as it is. A model of merges has ranks for
scores, whose sum means nothing (it prefers many frequent pieces to one rare
one): its ranks become log-probabilities by the law of Zipf and Mandelbrot.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

MARK = "▁"
#: Shift of ranks in the law of Zipf and Mandelbrot.
SHIFT = 2.7


def log_probabilities(scores: np.ndarray) -> np.ndarray:
    """Scores of a model's pieces; whole numbers that are not positive are ranks, rank r then having a probability in proportion to 1 / (r + SHIFT)."""
    if not len(scores) or (scores > 0).any() or (scores != np.floor(scores)).any():
        return scores
    total = float((1 / (np.arange(len(scores)) + SHIFT)).sum())
    return -np.log(-scores + SHIFT) - np.log(total)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Best-score segmentation into the pieces of a model; ``room`` bounds the words kept."""

    def __init__(self, path: str, room: int = 500_000):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        plain: list[int] = []
        crossing = False
        for i, piece in enumerate(self.texts):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
                crossing |= MARK in piece.lstrip(MARK)
        scores = log_probabilities(np.array([model.get_score(i) for i in plain], np.float64)).tolist()
        self.score = dict(zip(plain, scores, strict=True))
        for i, score in self.score.items():
            self.automaton.add_word(self.texts[i], (i, len(self.texts[i]), score))
        self.automaton.make_automaton()
        self.fallback = min(scores) - 10.0
        self.literal = [self.bytes[b] for b in MARK.encode()]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.words = re.compile("(?s).+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.border = None if crossing else re.compile(f"[^{MARK}]{MARK}")
        self.room = room
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the path of highest score; of equal paths the one whose last piece is longest, and so on backwards."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(-1, 0)] * (n + 1)
        matches = self.automaton.iter(text)
        end, found = next(matches, (n, None))
        for at in range(n):
            while end == at:
                i, size, score = found
                total = best[at + 1 - size] + score
                if total > best[at + 1] or (total == best[at + 1] and size > back[at + 1][1]):
                    best[at + 1], back[at + 1] = total, (i, size)
                end, found = next(matches, (n, None))
            if back[at + 1][1] == 0:
                best[at + 1], back[at + 1] = best[at] + self.fallback, (-1, 1)
        out: list[int] = []
        while n:
            i, size = back[n]
            out += [i] if i >= 0 else [self.bytes[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
            n -= size
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids. A mark in the text itself becomes its bytes, so that decoding gives the text back."""
        if not text:
            return b""
        if MARK in text:
            literal = np.array(self.literal, "<u4").tobytes()
            first, *rest = text.split(MARK)
            return self._plain(MARK + first.replace(" ", MARK)) + b"".join(literal + self._plain(x.replace(" ", MARK)) for x in rest)
        return self._plain(MARK + text.replace(" ", MARK))

    def _plain(self, text: str) -> bytes:
        """Ids of a text whose blanks are marks, a stretch of words at a time."""
        if len(text) <= 1 << 21:
            return self._stretch(text)
        out, start = [], 0
        while start < len(text):
            m = self.border.search(text, start + (1 << 20)) if self.border else None
            end = m.start() + 1 if m else len(text)
            out.append(self._stretch(text[start:end]))
            start = end
        return b"".join(out)

    def _stretch(self, text: str) -> bytes:
        words = self.words.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > self.room:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = np.array(self.viterbi(w), "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        if not ids:
            return ""
        numbers = np.frombuffer(ids, "<u4")
        if not hasattr(self, "parts"):
            self.parts = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.texts)]
        raw = b"".join([self.parts[i] for i in numbers.tolist()])
        return raw[1:].decode("utf-8", "replace")


@lru_cache(maxsize=1)
def pieces_at(path: str) -> Pieces:
    """The automaton of this worker; the words it has met stay for the next task."""
    return Pieces(path)


def encode_column(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds piece_ids (array of int): null for a null text, empty for an empty one. Other columns are kept; one of that name is replaced."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_at(path)
        for col in batches:
            yield pd.Series([None if t is None else np.frombuffer(pieces.encode(t), "<u4").astype(np.int32) for t in col], dtype=object)

    return df.withColumn("piece_ids", encode(F.col(text_col)))


def decode_column(df: DataFrame, ids_col: str = "piece_ids", path: str | None = None) -> DataFrame:
    """Adds decoded_text (string): null for null ids, empty for none."""
    path = path or default_path()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = pieces_at(path)
        for col in batches:
            yield pd.Series([None if t is None else pieces.decode(np.asarray(t, "<u4").tobytes()) for t in col], dtype=object)

    return df.withColumn("decoded_text", decode(F.col(ids_col)))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, same (the text came back).

    Ids are those of a path with the best score; of paths with equal scores the
    library's own encoder may take another. A null text counts as empty and has
    no pieces. Only texts go through Python: a null doc_id stays null and any
    other is kept as it is. Rows that repeat give rows that repeat, an empty table
    none; other columns, whatever their names, are ignored. A long text is encoded
    whole.
    """
    path = default_path()

    @F.pandas_udf("struct<n_pieces:long,n_byte_pieces:long,ids_crc32:long,decoded_sha256:string,same:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = pieces_at(path)
        is_byte = np.zeros(len(pieces.texts), bool)
        is_byte[list(pieces.byte_of)] = True
        for texts in batches:
            rows = []
            for text in texts:
                ids = pieces.encode(text)
                back = pieces.decode(ids)
                numbers = np.frombuffer(ids, "<u4")
                rows.append((len(numbers), int(is_byte[numbers].sum()), zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
            yield pd.DataFrame(rows, columns=["n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256", "same"])

    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run.asNondeterministic()(F.col("text").cast("string")).alias("made")).select("doc_id", "made.*")
