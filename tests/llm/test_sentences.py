import hashlib
import random
import re
from collections import Counter

import pytest

from trailweave.llm.sentences import OP2_SQL, find_spans, remove_repeats

SCHEMA = "doc_id long, text string, h1 string, till int"
END = ".!?\n\u3002\uff01\uff1f\u0964\u061f"
WORD = r"[\u3000-\u9fff]|[^ \t\r\n\x0b\x0c\u3000-\u9fff]+"


def brute(rows, least=2, words=20):
    """Sentences by a pattern, runs by lists of strings."""
    runs, parts = {}, {}
    for k, (_, text) in enumerate(rows):
        parts[k] = []
        for p in re.findall(f"[^{END}]+[{END}]*|[{END}]+", text or ""):
            found = [(hashlib.md5(m[0].encode()).digest()[:8], -m.start()) for m in re.finditer(WORD, p)]
            near = 4 * words // 5
            chosen = {-min(found[i : i + near])[1] for i in range(len(found) - near + 1)} if len(found) >= words else set()
            cuts = [0, *sorted(chosen - {-found[0][1]} if found else []), len(p)]
            parts[k] += [p[i:j] for i, j in zip(cuts, cuts[1:])]
        real = [i for i, p in enumerate(parts[k]) if p.strip(" \t\r\n\x0b\x0c")]
        for a in range(len(real)):
            n = 0
            for b in range(a, len(real)):
                n += len(re.findall(WORD, parts[k][real[b]]))
                if n >= words and b - a + 1 >= least:
                    key = tuple(parts[k][i].strip(" \t\r\n\x0b\x0c") for i in real[a : b + 1])
                    runs.setdefault(key, []).append((k, real[a], real[b]))
                    break
    gone = {k: set() for k in parts}
    for places in runs.values():
        for k, a, b in sorted(places, key=lambda x: (-1 if rows[x[0]][0] is None else rows[x[0]][0], *x))[1:]:
            gone[k] |= set(range(a, b + 1))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        kept = "".join(p for i, p in enumerate(parts[k]) if i not in gone[k]).encode()
        spans = sum(1 for i in gone[k] if i - 1 not in gone[k])
        out.append((doc_id, len((text or "").encode()), len((text or "").encode()) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(["the", "of", "aé", "bc", "de", "fg"]) + str(rng.randrange(40)) for _ in range(rng.choice([rng.randrange(1, 14), rng.randrange(1, 50)]))) + rng.choice([".", "!", "?\n", ".\n\n", "...", ".x", "\nY"])
    passage = [sentence() for _ in range(9)]
    rows = [(0, None), (1, ""), (2, "..."), (3, "no end"), (4, "\n\n a.\n")]
    for i in range(5, 60):
        own = [sentence() for _ in range(rng.randrange(3, 30))]
        a = rng.randrange(9)
        at = rng.randrange(len(own))
        own[at:at] = passage[a : a + rng.randrange(9)]
        if i % 7 == 0:
            own += own[:4]
        rows.append((i, " ".join(own)))
    rows += [(60, rows[20][1]), (61, "Same line here. " * 40)]
    ideographs = lambda: "".join(chr(0x4E00 + rng.randrange(30)) for _ in range(rng.randrange(3, 30))) + rng.choice("\u3002\uff01\uff1f")
    shared = [ideographs() for _ in range(5)]
    for i in range(62, 70):
        own = [ideographs() if i % 2 else ideographs() + "abc x" for _ in range(rng.randrange(1, 8))]
        rows.append((i, "".join(own + shared[i % 3 :] + own[:2])))
    rows += [(70, "\u0928 \u092e \u0964 " * 30), (71, "a b\u061f " * 30), (20, rows[20][1]), (None, rows[22][1]), (None, rows[22][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    assert got == brute(rows)


def test_rows_that_repeat_nulls_and_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "One two three four five six seven eight nine ten. One two three four five six seven eight nine eleven."
    df = spark.createDataFrame([(None, text, "a", 1), (7, text, "b", 2), (8, "Own words. " + text, None, None), (9, text, "c", 1), (9, text, "c", 1)], SCHEMA)
    out = {(r.doc_id, r.h1): (r.text, r.till) for r in remove_repeats(df, text_out=True).collect()}
    assert out[(9, "c")][0] == "" and out[(None, "a")] == (text, 1) and out[(7, "b")] == ("", 2) and out[(8, None)] == ("Own words.", None)


def test_a_passage_is_found_wherever_it_stands_in_long_sentences(spark):
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, passages = [], []
    for i in range(40):
        passages.append(own(rng.randrange(51, 60)) if i % 2 else [rng.choice(["the", "of", "a"]) + rng.choice(["", str(rng.randrange(9))]) for _ in range(rng.randrange(51, 60))])
        rows += [(2 * i, " ".join(own(rng.randrange(1, 25)) + passages[i] + own(rng.randrange(1, 25)))), (2 * i + 1, " ".join(own(rng.randrange(1, 25)) + passages[i] + own(rng.randrange(1, 25))))]
    rows.append((90, " ".join(own(400))))
    out = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    assert all(out[2 * i + 1].n_removed > 0 and out[2 * i].n_removed == 0 for i in range(1, 40, 2)) and all(out[2 * i + 1].n_removed > 0 for i in range(0, 40, 2))
    assert out[90].n_removed == 0
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.values())
    assert got == brute(rows)


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(11)
    marks = [". ", "! ", ".\n", "\u3002", " \u0964 ", " "]
    chunk = lambda: " ".join(rng.choice(["the", "of", "a\u00e9", "\u4e00\u4e8c\u4e09", "x\u4e00y", "tab\tq"]) + rng.choice(["", str(rng.randrange(40))]) for _ in range(rng.randrange(1, 40))) + rng.choice(marks)
    shared = [chunk() for _ in range(20)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else chunk() for _ in range(rng.randrange(12)))) for i in range(80)] + [(None, None), (3, ""), (4, " . ! ")]
    db = duckdb.connect()
    db.execute("create table documents(doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    want = Counter(db.sql(f"select doc_id, n_bytes, n_removed, n_spans, kept_sha256 from ({OP2_SQL})").fetchall())
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect())
    assert got == want == brute(rows)


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_texts_that_collide_in_polynomial_hashes(spark):
    parts = [thue_morse(1 << 11, "a", "b"), thue_morse(1 << 11, "b", "a")]
    rows = [(i, f"{p} " + " ".join(["w"] * 9) + ". " + " ".join(["v"] * 15) + ".") for i, p in enumerate(parts)]
    words = [" ".join(("left side of it", "other right one")[bin(i).count("1") % 2 ^ k] for i in range(1 << 11)) for k in (0, 1)]
    rows += [(2, words[0]), (3, words[1])]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect())
    assert got == brute(rows) and all(r[2] == 0 for r in got if r[0] < 2)


def test_a_text_of_many_pieces_equals_the_whole():
    rng = random.Random(8)
    text = "".join(rng.choice(["some words here", "more", "\u4e00\u4e8c", "a b c d e f g h i j k l"]) + rng.choice([". ", "! ", ".\n", "\n\n", "\u3002", "\n.\n "]) for _ in range(4000)).encode()
    for a, b in zip(find_spans(text, 2, 20), find_spans(text, 2, 20, 1000), strict=True):
        assert (a == b).all()


def test_a_long_sentence_is_cut_in_blocks_as_at_once(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["the", "of", f"w{rng.randrange(99)}"]) for _ in range(3000)).encode()
    whole = find_spans(text, 2, 20)
    monkeypatch.setattr("trailweave.llm.sentences.BLOCK", 100)
    assert len(whole[0]) > 300 and all((a == b).all() for a, b in zip(whole, find_spans(text, 2, 20), strict=True))
