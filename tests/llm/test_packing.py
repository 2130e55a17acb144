import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from trailweave.llm.packing import pack, plan
from trailweave.llm.tokenize import WordTokenizer, default_path

SCHEMA = "doc_id long, text string, piece int, rank string"


def check_slots(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400))] + [7] * 60
    hist = {n: lengths.count(n) for n in set(lengths)}
    slots = plan(hist, capacity)
    seen, fill = defaultdict(int), defaultdict(list)
    for n, rank, count, first, offset in slots.tolist():
        assert rank == seen[n]
        seen[n] += count
        for i in range(count):
            fill[first + i].append((offset, n))
    assert seen == hist
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(fill) <= best_fit(lengths, capacity)


def test_ids_equal_the_library(spark):
    t = WordTokenizer(default_path(), room=50)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = ["", " ", "a<|endoftext|>b", "Straße ẞ Œ ½² 3²", "don't 'S it'll x'LLx ''s", "é İ ſ", "a\x0bb\x1cd\x85e\xa0f", "日本 語", "_a_1__ 1_000", "퟿￾", "Σας ΟΔΟΣ"]
    for text in [*texts, *odd]:
        assert t.encode(text) == t.whole(text), text[:50]


class Counted:
    """A tokenizer that counts its calls."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def encode(self, *args, **kwargs):
        self.calls += 1
        return self.inner.encode(*args, **kwargs)


def test_new_words_of_many_texts_take_few_calls():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(3, 12))) + rng.choice(["", "", ",", "!!", "'s", "-7a"])
    texts = [" ".join(word() for _ in range(5)) for _ in range(400)]
    t = WordTokenizer(default_path())
    want = [t.whole(x) for x in texts]
    t.library, t.words = Counted(t.library), Counted(t.words)
    assert list(t.encode_all(texts)) == want
    assert t.library.calls + t.words.calls < 20  # one for each text before
    t.words.calls = 0
    assert list(t.encode_all(texts[::-1])) == want[::-1] and t.words.calls == 0


@pytest.mark.parametrize("group", [1, 40, 1 << 20])
def test_texts_encoded_together_keep_their_order(monkeypatch, group):
    monkeypatch.setattr("trailweave.llm.tokenize._GROUP", group)
    t = WordTokenizer(default_path(), room=12)
    texts = [None, "", "a b", "日本 a", " \n", "\tA  b\r\nc'll \n", "<|endoftext|>", "a-b 1a2 é É", None, "x" * 50, "a b", "'S ''s ½", "one two three four", "a b", ""]
    assert list(t.encode_all(texts)) == [t.whole(x or "") for x in texts]
    assert list(t.encode_all([])) == []
    assert list(t.encode_all([None, "日本"])) == [b"", t.whole("日本")]
    long = ("Été don't, " * 200_000) + "end"
    assert list(t.encode_all(["a", long, "b c"])) == [t.whole("a"), t.whole("Été don't, ") * 200_000 + t.whole("end"), t.whole("b c")]


def test_every_token_has_its_slot(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma7", "Été"]) for _ in range(n))
    rows = [(i, words(rng.randrange(1, 60)), 1, "x") for i in range(80)] + [(1000, words(400), 1, "x"), (1001, None, None, None), (1002, "", 2, ""), (None, words(5), 3, ""), (1003, words(20), 1, "a"), (1003, words(20), 1, "a"), (7, "same text", 0, ""), (7, "same text", 0, "")]
    got = pack(spark.createDataFrame(rows, SCHEMA), capacity=64).collect()
    t = WordTokenizer(default_path())
    want = []
    for doc_id, text, *_ in rows:
        ids = t.whole(text or "") + np.array([1], "<u4").tobytes()
        want += [(doc_id, k, s, min(64, len(ids) // 4 - s), zlib.crc32(ids[4 * s : 4 * s + 256])) for k, s in enumerate(range(0, len(ids) // 4, 64))]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(want, key=order)
    n = check_slots(got, 64)
    assert n <= best_fit([w[3] for w in want], 64)
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
