"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM.

Companded bytes are expanded by tables of 256 entries. ADPCM blocks of one
recording are decoded side by side: the loop runs over the samples of a block
and numpy over all blocks. Decoded PCM is resampled by linear interpolation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11

#: Fixed values of IMA ADPCM: the change of the step index for each code.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8, -1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Fixed values of IMA ADPCM: the step sizes.
IMA_STEP = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def _mulaw_table() -> np.ndarray:
    """G.711 mu-law: inverted bits, 3 bits of exponent, 4 of mantissa, bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 132 << ((u & 0x70) >> 4)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, 3 bits of exponent, 4 of mantissa."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def wav(kind: int, rate: int, data: bytes, bits: int = 8, block: int = 1, samples_per_block: int = 0) -> bytes:
    """A mono WAV file around the given bytes."""
    extra = struct.pack("<HH", 2, samples_per_block) if kind == IMA else b"" if kind == PCM else struct.pack("<H", 0)
    per_second = rate * block if kind != IMA else rate * block // max(1, samples_per_block)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, per_second, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if kind != PCM:
        frames = len(data) if kind != IMA else len(data) // block * samples_per_block
        body += b"fact" + struct.pack("<II", 4, frames & 0xFFFFFFFF)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


#: Fixed value of WAVE_FORMAT_EXTENSIBLE, whose own format stands at the beginning of its sub-format.
EXTENSIBLE = 0xFFFE


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview, int | None]:
    """(format, rate, block align, data bytes, frames that the file says it has, or None) of a mono WAV file; ValueError if it is none or ends before its data do."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, head, frames = 12, None, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt " and size >= 16:
            head = struct.unpack_from("<HHIIHH", view, at + 8)
            if head[0] == EXTENSIBLE and size >= 40:
                head = (struct.unpack_from("<H", view, at + 8 + 24)[0], *head[1:])
        elif name == b"fact" and size >= 4:
            frames = struct.unpack_from("<I", view, at + 8)[0]
        elif name == b"data":
            if head is None or head[1] != 1 or not head[2] or not head[4]:
                raise ValueError("no mono format before the data")
            if at + 8 + size > len(view):
                raise ValueError("the data end early")
            return head[0], head[2], head[4], view[at + 8 : at + 8 + size], frames
        at += 8 + size + size % 2
    raise ValueError("no data")


def decode_ima(data: bytes | memoryview, block: int) -> np.ndarray:
    """Mono IMA ADPCM; a last, shorter block is padded with zero codes and cut again."""
    raw = np.frombuffer(data, np.uint8)
    n, short = divmod(len(raw), block)
    last = (1 + 2 * max(0, short - 4)) if short >= 4 else 0
    if last:
        raw = np.concatenate([raw, np.zeros(block - short, np.uint8)])
        n += 1
    if not n:
        return np.zeros(0, np.int16)
    rows = raw[: n * block].reshape(n, block)
    value = rows[:, :2].copy().view("<i2").reshape(n).astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    codes = np.empty((n, 2 * (block - 4)), np.uint8)
    codes[:, ::2], codes[:, 1::2] = rows[:, 4:] & 15, rows[:, 4:] >> 4
    out = np.empty((n, 1 + codes.shape[1]), np.int16)
    out[:, 0] = value
    for i in range(codes.shape[1]):
        c = codes[:, i].astype(np.int32)
        step = IMA_STEP[index]
        change = (step >> 3) + np.where(c & 4, step, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 1, step >> 2, 0)
        value = np.clip(value + np.where(c & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[c], 0, 88)
        out[:, i + 1] = value
    flat = out.reshape(-1)
    return flat[: (n - 1) * out.shape[1] + last] if last else flat


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Sampling rate and 16-bit samples of a telephony WAV file. Samples of mu-law and A-law are the bytes of the data, whatever the file says of its frames."""
    kind, rate, block, data, frames = parse_wav(media)
    if kind in EXPAND:
        return rate, EXPAND[kind][np.frombuffer(data, np.uint8)]
    if kind == IMA and block > 4:
        return rate, decode_ima(data, block)[:frames]  # the last block is padded; the file says how far it counts
    if kind == PCM and block == 2:
        return rate, np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    raise ValueError(f"unknown format {kind}")


def resample(pcm: np.ndarray, rate: int, to: int, piece: int = 1 << 18) -> np.ndarray:
    """Linear interpolation at n * rate / to, in integer arithmetic, rounded half up; pieces bound the memory."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16, copy=False)
    n = len(pcm) * to // rate
    out = np.empty(n, np.int16)
    for a in range(0, n, piece):
        at = np.arange(a, min(n, a + piece), dtype=np.int64) * rate
        i, part = at // to, at % to
        here, after = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
        out[a : a + len(at)] = here + (2 * (after - here) * part + to) // (2 * to)
    return out


def features(pcm: np.ndarray, rate: int) -> str:
    """Frames, rate, root mean square, peak, zero crossings and checksum of 16-bit samples."""
    wide = pcm.astype(np.int64)
    rms = float(np.sqrt(np.mean(wide * wide))) if len(pcm) else 0.0
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"frames={len(pcm)};rate={rate};rms={rms:.3f};peak={int(np.abs(wide).max(initial=0))};zc={crossings};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def to_pcm(df: DataFrame, media_col: str = "media", rate: int = 16000) -> DataFrame:
    """Adds pcm_media (a PCM WAV at ``rate``) and media_error to a frame with a binary column.

    Null media give nulls in both. Bytes that are no mono WAV of a known format
    give a null and the reason. Empty data give a file of no samples. Every
    other column is kept; a column already named like a result is replaced.
    """
    out_cols = [f for f in df.schema.fields if f.name not in ("pcm_media", "media_error")]
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    @F.pandas_udf(StructType([StructField("pcm_media", BinaryType()), StructField("media_error", StringType())]))
    def convert(col: pd.Series) -> pd.DataFrame:
        done = []
        for media in col:
            if media is None:
                done.append((None, None))
                continue
            try:
                own, pcm = decode(media)
                done.append((wav(PCM, rate, resample(pcm, own, rate).astype("<i2").tobytes(), 16, 2), None))
            except ValueError as e:
                done.append((None, str(e)))
        return pd.DataFrame(done, columns=["pcm_media", "media_error"])

    kept = df.select(*[F.col(f"`{f.name}`") for f in out_cols])
    held = kept.select("*", convert(F.col(f"`{media_col}`")).alias("__pcm"))
    return held.select(*[F.col(f"`{f.name}`") for f in out_cols], F.col("__pcm.pcm_media").alias("pcm_media"), F.col("__pcm.media_error").alias("media_error"))


def store_text_as_audio(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, mu-law WAV whose samples are the text padded with bytes 0 to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
    return len(raw), wav(MULAW, 8000, padded)


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a mu-law file and back; the digest columns come from the bytes read back, the features from resampled PCM.

    A null or empty text is 64 bytes 0. Only texts go through Python: a null
    doc_id stays null and any other is kept as it is. Rows that repeat give rows
    that repeat, equal texts equal values, an empty table none; other columns,
    whatever their names, are ignored. A long text is stored whole.
    """

    @F.pandas_udf("struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string,pcm_bytes:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                n, media = store_text_as_audio(text)
                payload = parse_wav(media)[3]
                own, pcm = decode(media)
                stored = wav(PCM, 16000, resample(pcm, own, 16000).astype("<i2").tobytes(), 16, 2)
                rate, back = decode(stored)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back, rate), len(stored)))
            yield pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes"])

    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run.asNondeterministic()(F.col("text").cast("string")).alias("made")).select("doc_id", "made.*")
