"""Stretches of long texts give what the whole gives."""

import random

import numpy as np

from trailweave.llm.hashing import parts, shingles, word_hashes
from trailweave.llm.pieces import MARK, Pieces
from trailweave.llm.pieces import default_path as pieces_path
from trailweave.llm.quality import statistics
from trailweave.llm.sentences import find_spans
from trailweave.llm.suffixes import find_runs
from trailweave.llm.tokenize import WordTokenizer
from trailweave.llm.tokenize import default_path as words_path


def long_text(n):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ". ", "\n"]) for _ in range(n))


TEXT = long_text(600_000)


def test_parts():
    for text in ("", "a", "a b", "  ", "ab  cd ef", TEXT[:5000], "x" * 100):
        for size in (1, 3, 50):
            cut = list(parts(text, size))
            assert "".join(cut) == text and all(p.startswith(" ") and not before[-1].isspace() for before, p in zip(cut, cut[1:]))


def test_hashes_of_words_and_spans():
    assert len(TEXT) > 1 << 21
    own = [w for w in __import__("re").findall(r"[^\s.]+", TEXT)]
    got = word_hashes(TEXT)
    assert len(got) == len(own) and (got[-50:] == np.concatenate([word_hashes(w) for w in own[-50:]])).all()
    assert len(shingles(TEXT)) == len(own) - 4 and np.isfinite(statistics(TEXT)).all()
    data = np.frombuffer(TEXT.encode(), np.uint8)
    h, first, last = find_spans(data.tobytes(), 2, 20)
    again = find_spans(data[first[1000] :].tobytes(), 2, 20)[0]
    assert (again[:50] == h[1000:1050]).all() and (last > first).all()
    a, b = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(1 << 12)) for k in (0, 1)]
    assert word_hashes(a)[0] != word_hashes(b)[0]
    runs = find_runs(data, 200)
    assert runs[3].sum() == len(data) - 199 and (runs[3] <= 137).all()


def test_ids_of_long_texts():
    t = WordTokenizer(words_path())
    assert t.encode(TEXT) == b"".join(t.encode(p) for p in parts(TEXT, 100_000))
    assert t.encode(TEXT[:60_000]) == t.whole(TEXT[:60_000])
    p = Pieces(pieces_path())
    marked = MARK + TEXT.replace(" ", MARK)
    assert p._plain(marked) == p._stretch(marked) and p.decode(p.encode(TEXT)) == TEXT
    assert p.decode(p.encode("y" * (1 << 22))) == "y" * (1 << 22)
