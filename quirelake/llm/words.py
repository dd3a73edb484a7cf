"""Byte-level word kernels shared by the operators that read text in Python.

Both tables keep bytes from 0x80 on, so UTF-8 sequences stay whole and every non-ASCII code point counts as a word character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = np.frombuffer(LOWER, np.uint8)
#: A-Z to a-z, and all ASCII but letters and digits to a space.
ALNUM = bytes(LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each row in one array of bytes, which isn't copied; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"").cast(column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return bounds.astype(np.int64), np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)


def portions(batches: Iterator[pa.RecordBatch], text: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in portions of at most ``most`` bytes in column ``text``, or one row: what is worked on at a time stays small."""
    for b in batches:
        bounds, _ = raw(b.column(text))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def row_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row, one at a time; null is empty."""
    bounds, data = raw(column)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield data[lo:hi].tobytes()


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of ASCII letters and digits and of everything beyond ASCII."""
    return text.translate(ALNUM).split()


_SPACE = np.array([c in b" \t\n\v\f\r" for c in range(256)])


def numbered_words(column: pa.Array, most: int = 8_000_000) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased words between ASCII white space: the number of each, row after row; the distinct words by number; and how many each row has."""
    found, sizes = [], [np.zeros(0, np.int64)]
    for b in portions([pa.RecordBatch.from_arrays([column], names=["text"])], 0, most):
        bounds, data = raw(b.column(0))
        data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
        space = _SPACE[data]
        first = ~space
        first[1:] &= space[:-1]
        starts = bounds[:-1][np.diff(bounds) > 0]
        first[starts] = ~space[starts]
        where = np.flatnonzero(first)
        keep = ~space
        letters = _LOW[data[keep]]
        at = np.append(np.flatnonzero(first[keep]), len(letters)).astype(np.int32)
        found.append(pa.BinaryArray.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode())
        sizes.append(np.diff(np.searchsorted(where, bounds)))
    if not found:
        return np.zeros(0, np.int32), pa.array([], pa.binary()), sizes[0]
    chunks = pa.chunked_array(found).unify_dictionaries().chunks
    return np.concatenate([c.indices.to_numpy() for c in chunks]), chunks[0].dictionary, np.concatenate(sizes)


class WordHash(dict):
    """64-bit hash of a word, kept between batches up to ``most`` words of at most ``longest`` bytes."""

    def __init__(self, most: int = 400_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.longest:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Numbering(dict):
    """Consecutive numbers for words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def windows_repeated(ids: np.ndarray, width: int) -> int:
    """How many positions lie in a window of ``width`` ids that occurs twice or more in ``ids``. Exact: windows are ranked by doubling."""
    n = len(ids)
    if n <= width:
        return 0
    rank, have = ids.astype(np.int64), 1
    while have < width:
        step = min(have, width - have)
        left, right = rank[: len(rank) - step], rank[step:]
        _, rank = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
        have += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())
