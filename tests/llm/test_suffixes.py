import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailweave.llm.suffixes import remove_repeats

SCHEMA = "doc_id long, text string, bytes string, from int"


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                cover[i : i + width] = b"\1" * width
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(d), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, letters="abcdefgh éß": "".join(rng.choice(letters) for _ in range(n))
    shared, line = text(900), text(150)
    docs = [None, "", "short", text(199), shared, shared]
    for n in (200, 230, 400, 1500, 3000):
        a = rng.randrange(300)
        docs += [text(n), text(n) + shared[a : a + n] + text(50), shared[: n // 2] + line + text(n) + line, line + text(80) + line]
    edited = list(docs[-3])
    edited[len(edited) // 2] = "X"
    return [*docs, "".join(edited), "ab" * 700, "ab" * 500, "z" * 450, text(20000, "ab")]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    texts = corpus(seed)
    rows = [(i // 2 if i < 6 else i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "q" * 10, None, None), (None, None, None, None), (None, texts[7], None, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 200), strict=True))
    assert got == want


def test_empty_table_and_text_out(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(600))
    df = spark.createDataFrame([(1, base + "tail", "x", 3), (2, "é" + base, "y", 4), (3, None, None, None)], SCHEMA)
    out = {r.doc_id: r for r in remove_repeats(df, text_out=True).collect()}
    assert (out[1].text, out[1].bytes, out[1]["from"]) == ("tail", "x", 3)
    assert (out[2].text, out[3].text, out[3].n_bytes) == ("é", None, 0)
    big = spark.createDataFrame([(2**62 + 1, base, "x", 2**31 - 1), (None, base + "z", None, None), (2**62 + 3, None, "y", 5)], SCHEMA)
    assert {(r.doc_id, r.bytes, r["from"]) for r in remove_repeats(big, text_out=True).collect()} == {(2**62 + 1, "x", 2**31 - 1), (None, None, None), (2**62 + 3, "y", 5)}


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_null_ids_and_texts_that_collide_in_polynomial_hashes(spark):
    rng = random.Random(9)
    texts = [thue_morse(1 << 12, "a", "b"), thue_morse(1 << 12, "b", "a"), "x" + thue_morse(1 << 11, "ab", "ba") + "y", "x" + thue_morse(1 << 11, "ba", "ab") + "z"]
    filler = ["".join(rng.choice("abcdefgh ") for _ in range(384)) for _ in range(300)]
    texts += filler
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame([(None, t, "x", 1) for t in texts], SCHEMA)).collect())
    assert got == Counter(brute(texts, 200))
    # Two texts of 200 bytes and more with the same 32-bit hash, which are found among 160,000.
    some = spark.range(160000).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.concat(F.lit("a"), F.col("id")), 512)).alias("m"))
    same = [m for r in some.groupBy(F.hash("m")).agg(F.collect_list("m").alias("l")).where("size(l) > 1").collect() for m in r["l"]]
    assert len(same) >= 2
    assert all(r.n_removed == 0 for r in remove_repeats(spark.createDataFrame([(None, m, "x", 1) for m in same], SCHEMA)).collect())


def test_key_takes_another_salt_when_rows_clash(spark, monkeypatch):
    from trailweave.llm import spans

    true, asked = F.xxhash64, []

    def narrow(salt, *rest):
        asked.append(salt)
        return true(salt, *rest) % (3 if len(asked) == 1 else 1 << 40)

    monkeypatch.setattr(spans.F, "xxhash64", narrow)
    rows = [(None, f"{i}", "x", 1) for i in range(50)] + [(None, "7", "y", 2), (1, None, "", 0), (1, "", "", 0)]
    keys = spans.keyed(spark.createDataFrame(rows, SCHEMA), []).select("key", "doc_id", "text").collect()
    assert len(asked) == 2 and len({r.key for r in keys}) == 51
