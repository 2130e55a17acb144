"""Vectorised hashes over the bytes of a text.

A polynomial hash in 64-bit wrap-around arithmetic with an odd radix: prefix
sums give the hash of any substring in constant time, whatever its length.
Byte values go through a random table first and sums through a finaliser. Texts
of the Thue-Morse kind collide for every odd radix, so this hash only ever picks
candidates; what is removed is decided by ``digests``.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U64 = np.uint64
MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values from ``seed`` (the SplitMix64 rule)."""
    with np.errstate(over="ignore"):
        return mix(U64(seed & MASK) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64; a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Rolling:
    """Prefix hashes of byte strings; powers of the radix grow on demand."""

    def __init__(self, seed: int):
        self.byte = splitmix(seed, 256)
        self.radix = int(splitmix(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.radix, -1, 1 << 64)
        self.pow = self.inv = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow), 1 << 16)
            for name, base in (("pow", self.radix), ("inv", self.inverse)):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """H with H[i] the sum over the first i bytes."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.byte[data] * self.pow[: len(data)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for arrays of bounds."""
        return mix((prefix[end] - prefix[start]) * self.inv[start] + np.asarray(end - start).astype(U64))

    def windows(self, prefix: np.ndarray, q: int) -> np.ndarray:
        """Hash of every window of q bytes."""
        n = len(prefix) - q
        return mix((prefix[q:] - prefix[:n]) * self.inv[:n] + U64(q))


def digests(data: np.ndarray | bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of 128 bits of each data[start:end], as two signed 64-bit numbers."""
    view = memoryview(data)
    each = [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(each), np.int64).reshape(-1, 2)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    top = np.array(np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, np.full(pad, top)]).reshape(-1, w) if pad else x.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


#: Bytes that end a word: ASCII white space and punctuation but for the apostrophe.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[b for b in range(128) if not (chr(b).isalnum() or b == 39)]] = True

_WORDS = Rolling(71)
#: Bytes from which on a word is hashed by its digest; shorter ones are too short to collide by their structure.
LONG_WORD = 64


def parts(text: str, size: int = 1 << 20):
    """The text in stretches of about ``size`` characters that end before a blank which follows another character; a stretch without such a blank goes on. Memory then follows the stretch, not the text."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word of the lower-cased text, in order."""
    out = []
    for part in parts(text):
        data = np.frombuffer(part.lower().encode("utf-8", "surrogatepass"), np.uint8)
        if len(data):
            inside = np.zeros(len(data) + 2, np.int8)
            inside[1:-1] = ~_SEPARATOR[data]
            edge = np.flatnonzero(np.diff(inside))
            first, last = edge[::2], edge[1::2]
            h = _WORDS.span(_WORDS.prefix(data), first, last)
            if len(long := np.flatnonzero(last - first >= LONG_WORD)):
                h[long] = digests(data, first[long], last[long])[:, 0].view(U64)
            out.append(h)
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, U64)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Hashes of each run of ``size`` words; a shorter text is one shingle of all its words, one without words has none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < size:
            out = np.array([n], U64)
            for w in words:
                out = mix(out * U64(0x9E3779B97F4A7C15) + w)
            return out
        out = np.full(n - size + 1, size, U64)
        for k in range(size):
            out = out * U64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k]
        return mix(out)
