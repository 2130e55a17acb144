import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm.audio import ALAW, EXPAND, IMA, IMA_INDEX, IMA_STEP, MULAW, PCM, decode, decode_ima, op7_telephony, parse_wav, resample, store_text_as_audio, to_pcm, wav


def test_tables_by_the_standard():
    assert [int(EXPAND[MULAW][b]) for b in (0x00, 0x7F, 0x80, 0xFF, 0x0F, 0x8F)] == [-32124, 0, 32124, 0, -16764, 16764]
    assert [int(EXPAND[ALAW][b]) for b in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    assert sorted(set(EXPAND[ALAW].tolist())) == sorted(EXPAND[ALAW].tolist())
    assert len(IMA_STEP) == 89


def ima_scalar(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for c in (byte & 15, byte >> 4):
            step = int(IMA_STEP[index])
            d = step >> 3
            d += step if c & 4 else 0
            d += step >> 1 if c & 2 else 0
            d += step >> 2 if c & 1 else 0
            value = max(-32768, min(32767, value - d if c & 8 else value + d))
            index = max(0, min(88, index + int(IMA_INDEX[c])))
            out.append(value)
    return out


def test_adpcm_equals_a_scalar_decoder():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 64 * 40 + 23, dtype=np.uint8).tobytes()
    want = [v for a in range(0, 64 * 40, 64) for v in ima_scalar(data[a : a + 64])] + ima_scalar(data[64 * 40 :])
    assert decode_ima(data, 64).tolist() == want
    assert decode_ima(b"", 64).tolist() == [] and decode_ima(data[:3], 64).tolist() == []


def test_resampling_in_pieces_and_by_ratio():
    pcm = np.array([0, 10, -10, 32767, -32768], np.int16)
    assert resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 0, -10, 16379, 32767, 0, -32768, -32768]
    long = np.random.default_rng(1).integers(-3000, 3000, 5001).astype(np.int16)
    assert (resample(long, 8000, 11025, 100) == resample(long, 8000, 11025)).all()
    assert len(resample(long[:0], 8000, 16000)) == 0


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 33, "\x00", "word " * 30000])
def test_round_trip(text):
    n, media = store_text_as_audio(text)
    raw = (text or "").encode()
    payload = bytes(parse_wav(media)[3])
    assert n == len(raw) and payload[:n] == raw and not payload[n:].strip(b"\0")
    assert len(payload) % 64 == 0 and len(payload) >= max(64, n) and len(payload) - n <= 64
    rate, pcm = decode(media)
    assert rate == 8000 and len(pcm) == len(payload)


def test_query_rows(spark, tmp_path):
    rows = [(1, None, 5), (2, "", 6), (3, "hello", 7), (4, "hello", 8), (None, "z" * 64, 9), (2**62 + 1, "big", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, feature int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op7_telephony(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got[3][1:] == got[4][1:] and got[1][1:] == got[2][1:]
    payload = b"hello" + b"\0" * 59
    assert (got[3].n_bytes, got[3].payload_bytes, got[3].payload_sha256, got[3].tail_crc32) == (5, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    assert got[3].media_sha256 == hashlib.sha256(store_text_as_audio("hello")[1]).hexdigest() and "frames=128" in got[3].feature


def test_column_of_media(spark):
    ima = wav(IMA, 8000, bytes(range(128)), 4, 64, 121)
    rows = [(1, wav(ALAW, 8000, b"\x00\xff" * 50), "a"), (2, ima, "b"), (3, b"junk", "c"), (4, None, None), (5, wav(PCM, 16000, b"\1\0" * 3, 16, 2), "d"), (6, wav(MULAW, 8000, b""), "e"), (7, b"", "f")]
    got = {r.id: r for r in to_pcm(spark.createDataFrame(rows, "id int, media binary, pcm_media string")).collect()}
    assert len(decode(bytes(got[1].pcm_media))[1]) == 200 and len(decode(bytes(got[2].pcm_media))[1]) == 2 * 2 * 121
    assert got[3].pcm_media is None and got[3].media_error == "no WAV file" and got[7].media_error
    assert got[4].pcm_media is None and got[4].media_error is None
    assert decode(bytes(got[5].pcm_media))[1].tolist() == [1, 1, 1] and decode(bytes(got[6].pcm_media))[1].tolist() == []
    assert to_pcm(spark.createDataFrame([], "media binary")).select(F.count("*")).first()[0] == 0


def test_query_equals_plain_recomputation(spark):
    """Every column of every row of the test documents, by whole numbers of Python."""
    from collections import Counter

    table = [int(x) for x in EXPAND[MULAW]]

    def plain(text):
        raw = (text or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        n, per = len(payload), 8000
        fmt = (7).to_bytes(2, "little") + (1).to_bytes(2, "little") + per.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"\0\0"
        body = b"WAVEfmt " + len(fmt).to_bytes(4, "little") + fmt + b"fact" + (4).to_bytes(4, "little") + n.to_bytes(4, "little") + b"data" + n.to_bytes(4, "little") + payload
        media = b"RIFF" + len(body).to_bytes(4, "little") + body
        pcm = [table[b] for b in payload]
        twice = [v for i, v in enumerate(pcm) for v in (v, (v + (pcm[i + 1] if i + 1 < n else v) + 1) // 2)]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(twice, twice[1:]))
        feature = f"frames={len(twice)};rate=16000;rms={(sum(v * v for v in twice) / len(twice)) ** 0.5:.3f};peak={max(map(abs, twice))};zc={crossings};crc={zlib.crc32(b''.join(v.to_bytes(2, 'little', signed=True) for v in twice))}"
        return len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    dir_ = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{dir_}/documents.parquet").collect()
    got = Counter((r.doc_id, *r[1:8]) for r in op7_telephony(spark, dir_).collect())
    assert got == Counter((r.doc_id, *plain(r.text)) for r in docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, made int").write.parquet(f"{tmp_path}/documents.parquet")
    assert op7_telephony(spark, str(tmp_path)).collect() == []


def test_files_that_end_early_are_padded_or_extended():
    ok = wav(MULAW, 8000, b"\x00" * 100)
    with pytest.raises(ValueError, match="early"):
        parse_wav(ok[:-1])
    ima = wav(IMA, 8000, bytes(range(128)), 4, 64, 121)
    at = ima.index(b"fact") + 8
    assert len(decode(ima)[1]) == 242 and len(decode(ima[:at] + (200).to_bytes(4, "little") + ima[at + 4 :])[1]) == 200
    fmt = ok.index(b"fmt ") + 8
    own = ok[fmt : fmt + 18]
    extended = b"\xfe\xff" + own[2:16] + (22).to_bytes(2, "little") + b"\x08\0" + b"\0" * 4 + b"\x07\0" + bytes(14)
    body = b"WAVEfmt " + len(extended).to_bytes(4, "little") + extended + ok[fmt + 18 :]
    assert decode(b"RIFF" + len(body).to_bytes(4, "little") + body)[1].tolist() == decode(ok)[1].tolist()
