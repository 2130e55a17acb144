import random

import pytest

from trailweave.llm.pieces import MARK, Pieces, decode_column, default_path, encode_column


@pytest.fixture(scope="module")
def pieces():
    return Pieces(default_path(), room=20)


def brute(p, text):
    """Best score of every way to cut a short text, without automaton or store."""
    score = {p.texts[i]: s for i, s in p.score.items()}
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if text[i:j] in score:
                best[j] = max(best[j], best[i] + score[text[i:j]])
        if best[j] == float("-inf"):
            best[j] = best[j - 1] + p.fallback
    return best[-1], score


def test_best_score_equals_brute_force(pieces):
    rng = random.Random(1)
    for _ in range(25):
        text = MARK + "".join(rng.choice("abcdehinorst  éЖ語.,1") for _ in range(rng.randrange(1, 25))).replace(" ", MARK)
        want, score = brute(pieces, text)
        got, run = 0.0, 0
        for i in pieces.viterbi(text):
            if i in pieces.byte_of:
                run += 1
                if (pieces.byte_of[i] & 0xC0) != 0x80:
                    got += pieces.fallback
            else:
                got += score[pieces.texts[i]]
        assert got == pytest.approx(want)


def test_words_make_the_same_path_as_the_whole(pieces):
    rng = random.Random(2)
    for _ in range(20):
        text = MARK + MARK.join("".join(rng.choice("thenadis") for _ in range(rng.randrange(0, 9))) for _ in range(8))
        import numpy as np

        assert np.frombuffer(pieces._plain(text), "<u4").tolist() == pieces.viterbi(text)


ODD = ["", " ", "  a  b ", f"{MARK}x{MARK} {MARK}", "日本語 😀", "\n\t\x00 x", "é́", "a" * 5000, " lead", "trail "]


def test_round_trip(pieces):
    for text in ODD:
        assert pieces.decode(pieces.encode(text)) == text


def test_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, None), (5, "dup", ""), (5, "dup", "")]
    df = spark.createDataFrame(rows, "id int, text string, decoded_text string")
    got = decode_column(encode_column(df)).collect()
    assert len(got) == len(rows) and all(r.decoded_text == r.text for r in got)
    assert [r.piece_ids for r in got if r.id == 99] == [None]
    assert encode_column(spark.createDataFrame([], "text string")).collect() == []


def test_query_equals_brute_force(spark, tmp_path, pieces):
    """Each row of the query against the best score of every cut, the ids' bytes and the text that they stand for."""
    import hashlib
    import zlib

    import numpy as np

    from trailweave.llm.pieces import op8_pieces

    rng = random.Random(5)
    texts = [None, *ODD[:7], *["".join(rng.choice("the quick brn fox, 1éЖ語") for _ in range(rng.randrange(1, 60))) for _ in range(30)]]
    rows = [(None if i == 3 else 2**62 + 2 * i + 1, t, i) for i, t in enumerate(texts)] + [(7, "same", 0), (7, "same", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, made int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_pieces(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) - 1
    for doc_id, text, _ in rows:
        r = got[doc_id]
        ids = np.frombuffer(pieces.encode(text), "<u4")
        assert (r.n_pieces, r.ids_crc32, r.same) == (len(ids), zlib.crc32(ids.tobytes()), True)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest() and r.n_byte_pieces == sum(int(i) in pieces.byte_of for i in ids)
        if text and MARK not in text:
            want, score = brute(pieces, (MARK + text).replace(" ", MARK))
            have = sum(pieces.fallback * ((pieces.byte_of[i] & 0xC0) != 0x80) if i in pieces.byte_of else score[pieces.texts[i]] for i in ids.tolist())
            assert have == pytest.approx(want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op8_pieces(spark, f"{tmp_path}/none").collect() == []


def test_scores_of_ranks_and_of_probabilities():
    import numpy as np

    from trailweave.llm.pieces import log_probabilities

    logs = np.array([-1.5, -2.0, -3.25])
    assert (log_probabilities(logs) == logs).all() and len(log_probabilities(logs[:0])) == 0
    ranks = log_probabilities(-np.arange(1000.0))
    assert np.exp(ranks).sum() == pytest.approx(1) and (np.diff(ranks) < 0).all()


def test_agreement_with_the_library(pieces):
    """The library merges pairs by rank, which is no best path; still most words get its pieces."""
    import pyarrow.parquet as pq
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=default_path())
    words = [w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t for w in t.split()][:20000]
    known = {w: pieces.viterbi(MARK + w) == m.encode(w) for w in set(words) if MARK not in w}
    same = sum(known.get(w, False) for w in words) / len(words)
    print(f"{same:.3f} of words have the library's ids")
    assert same > 0.7
