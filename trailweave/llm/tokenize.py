"""Token ids of whole texts by a public word-level BPE file.

The tokenizer never joins what white space parts, and the ids of such a chunk do
not depend on its neighbours; nor does it join the words, digits and runs of
marks of a chunk. So many texts are split at once, each different chunk is
looked up once for all of them, and their ids are gathered as arrays. Each
worker keeps the ids of the chunks and words it has met, and the library only
encodes words that are new. Texts with characters for which the rule is not
certain to be the library's go through the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hashing import parts

#: Characters for which lower-casing and splitting at white space agree with the library: printable ASCII with usual white space, Latin-1 letters and marks, Latin Extended-A without the dotted capital I.
_KNOWN = re.compile(r"[\t\n\r -~¡-įı-ſ]*")
_WORDS = re.compile(r"[a-zªµºß-öø-ÿā-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿā-ſ²³¹¼½¾]+|\n")
#: Stands for a line break between chunks while they are learnt: no id has these bytes, nor do ids side by side.
_GAP = b"\xff\xff\xff\xff"
_FIXED = {"": b"", "\n": _GAP}
#: Characters of texts that are encoded together.
_GROUP = 8 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Little-endian unsigned 32-bit ids of texts; ``room`` bounds the words kept."""

    def __init__(self, path: str, room: int = 600_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)  # the same model for what is lower-cased and parted already
        self.words.normalizer = None
        self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.room = room
        self.ids: dict[str, bytes] = dict(_FIXED)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encode the words of new chunks that are new themselves, many at a time with blanks between."""
        mixed = [c for c in chunks if not c.isalpha()]
        found = _WORDS.findall("\n".join(mixed))
        words = [c for c in chunks if c.isalpha()]
        words += set(found).difference(self.ids, words)
        for a in range(0, len(words), 500):
            some = words[a : a + 500]
            e = self.words.encode(" ".join(some), add_special_tokens=False)
            own = np.array(e.word_ids, np.int64)
            cut = np.searchsorted(own, np.arange(len(some) + 1))
            if len(own) and own[-1] == len(some) - 1 and (np.diff(cut) > 0).all():
                ids, cut = np.array(e.ids, "<u4").tobytes(), (4 * cut).tolist()
                self.ids.update(zip(some, [ids[i:j] for i, j in zip(cut, cut[1:], strict=False)], strict=True))
            else:
                self.ids.update((w, self.whole(w)) for w in some)
        if mixed:
            self.ids.update(zip(mixed, b"".join(map(self.ids.__getitem__, found)).split(_GAP), strict=True))

    def _known(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of lower-cased texts. Each different chunk is looked up once for all of them. Once the room is full, only those met again in these texts stay."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        codes = lists.values.dictionary_encode()
        chunks = pc.binary_join(pa.ListArray.from_arrays([0, len(codes.dictionary)], codes.dictionary), "\n")[0].as_py().split("\n")
        found = list(map(self.ids.get, chunks))
        new = [c for c, f in zip(chunks, found, strict=True) if f is None]
        if new:
            if len(self.ids) + len(new) > self.room:
                self.ids = _FIXED | {c: f for c, f in zip(chunks, found, strict=True) if f is not None}
            for a in range(0, len(new), 20_000):
                self._learn(new[a : a + 20_000])
            learnt = map(self.ids.__getitem__, new)
            found = [next(learnt) if f is None else f for f in found]
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, found), np.int32, len(found)) // 4, out=ends[1:])
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4"))).take(codes.indices)
        data, at = ids.values.to_numpy(), ids.offsets.to_numpy()[lists.offsets.to_numpy()].tolist()
        return (data[i:j].tobytes() for i, j in zip(at, at[1:], strict=False))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; texts are worked on together, some ``_GROUP`` characters at a time."""
        held: list[str | bytes] = []
        size = 0
        for text in texts:
            held.append(self._plain(text))
            size += len(text or "") + 1
            if size > _GROUP:
                yield from self._in_turn(held)
                held, size = [], 0
        yield from self._in_turn(held)

    def _in_turn(self, held: list[str | bytes]) -> Iterator[bytes]:
        texts = [t for t in held if isinstance(t, str)]
        known = self._known(texts) if texts else iter(())
        return (next(known) if isinstance(t, str) else t for t in held)

    def _plain(self, text: str | None) -> str | bytes:
        """A text as its chunks are known, or its ids if it is one for the library, or a long one."""
        if not text:
            return b""
        plain = text if text.isascii() else unicodedata.normalize("NFC", text)
        if not _KNOWN.fullmatch(plain) or "<|startoftext|>" in text or "<|endoftext|>" in text:
            return self.whole(text)
        if len(plain) > 1 << 21:
            return b"".join(next(self._known([p.lower()])) for p in parts(plain))
        return plain.lower()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=1)
def tokenizer_at(path: str) -> WordTokenizer:
    """The tokenizer of this worker; the words it has met stay for the next task."""
    return WordTokenizer(path)
