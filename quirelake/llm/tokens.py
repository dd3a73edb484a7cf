"""Ids of whole texts by a public tokenizer, with the ids of each stretch kept and reused.

The tokenizer used here drops white space and parts letters, digits and signs, so a text may be cut wherever one of its tokens must end: the
ids of the text are those of its stretches in order. Cuts are made only beside ASCII characters and where no match and no composition of
code points can reach across; everything else stays together and goes to the tokenizer whole. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import LOWER, raw

#: What a tokenizer must do before its merges, for stretches to be its own.
NORMALIZER = {
    "type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed",
            "invert": True
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Every special string of such a tokenizer begins so; texts that hold it are encoded whole.
SPECIAL = "<|"

SPACE, LETTER, DIGIT, SIGN, HIGH, QUOTE = range(6)
_LOW = np.frombuffer(LOWER, np.uint8)
_CLASS = np.array(
    [SPACE if c in b" \t\n\v\f\r" else HIGH if c > 127 else QUOTE if c == 39 else LETTER if chr(c).isalpha() else DIGIT if 48 <= c <= 57 else SIGN for c in range(256)],
    np.uint8
)


def _cuts() -> np.ndarray:
    """Whether a stretch begins between two classes of bytes. An apostrophe may belong to the letters after it, or to signs beside it."""
    out = np.zeros((8, 8), bool)
    out[SPACE, 1:] = True
    out[LETTER, [DIGIT, SIGN, QUOTE]] = True
    out[DIGIT, [LETTER, DIGIT, SIGN, QUOTE]] = True
    out[SIGN, [LETTER, DIGIT]] = True
    out[QUOTE, DIGIT] = True
    return out.ravel()


_CUTS = _cuts()
#: One token of the tokenizer's own, whatever stands beside it: letters (those beyond ASCII are looked at once decoded), signs, or a digit.
_ONE = re.compile(rb"[a-z\x80-\xc9]+|[!-/:-@\[-`{-~]+|[0-9]")


def _latin_end(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``at`` end one of the letters U+00C0 to U+024F, which stay letters also once lower-cased (but U+0130)."""
    lead, trail = np.where(at > 0, b[at - 1], 0), b[at]
    return ((lead == 0xC3) & (trail != 0x97) & (trail != 0xB7)) | (
        (lead >= 0xC4) & (lead <= 0xC8) & ~((lead == 0xC4) & (trail == 0xB0))
    ) | ((lead == 0xC9) & (trail <= 0x8F))


def _plain(stretch: bytes) -> bool:
    """Whether letters of this stretch beyond ASCII are all of those ranges, so that it is one token of letters."""
    if stretch.isascii():
        return True
    s = stretch.decode("utf-8", "replace")
    return s.isalpha() and min(c for c in s if c > "\x7f") >= "À" and max(s) < "ɐ" and "İ" not in s


def stretches(b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes that begin texts at ``starts``: the bytes without white space, where stretches begin in them, and where in ``b``.

    Capital ASCII letters are lower-cased as the tokenizer would do, except where a code point beyond ASCII follows, with which they might compose.
    """
    k, low = _CLASS[b], _LOW[b]
    first = np.empty(len(b), bool)
    first[0] = k[0] != SPACE
    pair = k[:-1] * np.uint8(8) + k[1:]
    first[1:] = _CUTS[pair]
    high = k == HIGH
    if high.any():
        caps = np.flatnonzero(pair == LETTER * 8 + HIGH)
        low[caps] = b[caps]
        ends = np.flatnonzero(high[:-1] & ((k[1:] == DIGIT) | (k[1:] == SIGN) | (k[1:] == QUOTE)))
        first[ends[_latin_end(b, ends)] + 1] = True
    first[starts] = k[starts] != SPACE
    keep = k != SPACE
    return low[keep], np.flatnonzero(first[keep]), np.flatnonzero(first)


class StretchTokenizer(dict):
    """Maps a stretch of bytes to its place in the tables of ids.

    most, most_bytes: stretches and bytes of them that are held; beyond it the first ``keep`` stay, which are the frequent ones, but for long ones.
    """

    def __init__(self, path: str, most: int = 250_000, keep: int = 125_000, most_bytes: int = 8_000_000):
        super().__init__()
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.keep, self.most_bytes, self.n_bytes = Tokenizer.from_file(path), most, min(keep, most // 2), most_bytes, 0
        self.n_vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_stretch = self._parts_words()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.n_vocab)])
        self.flat, self.starts, self.sizes = array("i"), array("i"), array("i")

    def _parts_words(self) -> bool:
        t = self.tokenizer
        own = [x and json.loads(x.__getstate__()) for x in (t.normalizer, t.pre_tokenizer)]
        specials = [x.content for x in t.get_added_tokens_decoder().values()]
        return own == [NORMALIZER, PRE_TOKENIZER] and getattr(
            t.model, "end_of_word_suffix", None
        ) == "</w>" and not t.model.dropout and all(SPECIAL in x for x in specials)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _shrink(self) -> None:
        flat, starts, sizes = self.flat, self.starts, self.sizes
        kept = [(w, flat[starts[i] : starts[i] + sizes[i]]) for w, i in islice(self.items(), self.keep) if len(w) <= 64]
        self.clear()
        self.n_bytes, self.flat, self.starts, self.sizes = 0, array("i"), array("i"), array("i")
        self._put([w for w, _ in kept], np.concatenate([np.zeros(0, np.int32), *(x for _, x in kept)]), [len(x) for _, x in kept])

    def _put(self, some: list[bytes], ids: np.ndarray, sizes) -> None:
        sizes = np.asarray(sizes, np.int32)
        before = len(self.starts)
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.flat.frombytes(np.asarray(ids, np.int32).tobytes())
        self.update(zip(some, range(before, before + len(some)), strict=True))
        self.n_bytes += sum(map(len, some))

    def _learn(self, some: list[bytes], group: int = 1000) -> None:
        """Ids of stretches that aren't known. Those of one token are encoded many to a call, whose ids are parted where a token ends."""
        one, other = [], []
        for x in some:
            (one if _ONE.fullmatch(x) and _plain(x) else other).append(x)
        groups = [one[at : at + group] for at in range(0, len(one), group)]
        for words, ids in zip(groups, self._encode([b" ".join(g).decode() for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words):
                self._put(words, ids, np.diff(ends, prepend=0))
            else:
                other += words
        for at in range(0, len(other), group):
            words = other[at : at + group]
            got = self._encode([w.decode("utf-8", "replace") for w in words])
            self._put(words, np.concatenate([np.asarray(x, np.int32) for x in got]), [len(x) for x in got])

    def _of_bytes(self, b: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each of the texts that lie one after the other in ``b``."""
        if not len(b):
            return [np.zeros(0, np.int32)] * (len(bounds) - 1)
        starts = bounds[:-1][np.diff(bounds) > 0]
        data, at, where = stretches(b, starts)
        words = pa.BinaryArray.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self) > self.most or self.n_bytes > self.most_bytes:
            self._shrink()
        if lacking := [w for w in distinct if w not in self]:
            self._learn(lacking)
        which = np.fromiter(map(self.__getitem__, distinct), np.int32, len(distinct))[words.indices.to_numpy()]
        flat, first, sizes = (np.frombuffer(x, np.int32) for x in (self.flat, self.starts, self.sizes))
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int64)
        ids = flat[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        split = np.concatenate([[0], ends])[np.searchsorted(where, bounds)]
        return [ids[x:y] for x, y in zip(split[:-1].tolist(), split[1:].tolist(), strict=True)]

    def many(self, texts: list[bytes] | pa.Array, group: int = 1_500_000) -> Iterator[np.ndarray]:
        """int32 ids of each text; about ``group`` bytes of text are worked on at a time, of long texts as of many."""
        column = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        if not self.by_stretch:
            for t in column.cast(pa.string()).fill_null("").to_pylist():
                yield np.array(self._encode([t])[0], np.int32)
            return
        bounds, data = raw(column)
        special = pc.fill_null(pc.match_substring(column, SPECIAL), False).to_numpy(zero_copy_only=False) if len(column) else []
        at = 0
        while at < len(column):
            if special[at] or bounds[at + 1] - bounds[at] > group:
                yield self._alone(data[bounds[at] : bounds[at + 1]], group, special[at])
                at += 1
                continue
            to = at + 1
            while to < len(column) and bounds[to + 1] - bounds[at] <= group and not special[to]:
                to += 1
            yield from self._of_bytes(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            at = to

    def _alone(self, b: np.ndarray, group: int, special: bool) -> np.ndarray:
        """One text: whole if it may hold a special string, else in parts that end at white space."""
        if special:
            return np.array(self._encode([b.tobytes().decode("utf-8", "replace")])[0], np.int32)
        out, at = [], 0
        while at < len(b):
            to, step = len(b), group
            while at + step < len(b):
                if len(gaps := np.flatnonzero(_CLASS[b[at : at + step]] == SPACE)):
                    to = at + int(gaps[-1]) + 1
                    break
                step *= 2
            out += self._of_bytes(b[at:to], np.array([0, to - at]))
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def ids(self, text: bytes) -> np.ndarray:
        return next(self.many([text]))


_loaded: dict[str, StretchTokenizer] = {}


def load(path: str) -> StretchTokenizer:
    """One tokenizer for each path and process."""
    if path not in _loaded:
        _loaded[path] = StretchTokenizer(path)
    return _loaded[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
