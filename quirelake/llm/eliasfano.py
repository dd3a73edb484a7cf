"""Elias-Fano coding of non-decreasing integers, and token shards that use it for document boundaries.

A sequence of n values below u takes about n * (2 + log2(u / n)) bits: each value's low bits in a packed array, its high bits in unary. Every
``SAMPLE``-th set bit's position is noted in 32 bits, from which ``select`` finds any value by a short scan.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
MAGIC = b"QLTOKEN1"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of set bit k of each byte; 8 where it has no such bit.
_PLACE = np.array([([j for j in range(8) if i >> j & 1] + [8] * 8)[:8] for i in range(256)], np.int64)


class EliasFano:
    """Encoded values; ``select(i)`` gives one, ``select_many`` any number, ``all()`` every one."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        if v[0] < 0 or (np.diff(v) < 0).any():
            raise ValueError("values must not be negative and must not fall")
        low_bits = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1)
        low = np.packbits((v[:, None] >> np.arange(low_bits)) & 1 == 1, bitorder="little").tobytes() if low_bits else b""
        ones = (v >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, bool)
        bits[ones] = True
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (part >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        here = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := int(_ones_in(here))) <= left:
            left -= ones
            byte += 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        bit = byte * 8 + ((here & -here).bit_length() - 1)
        return ((bit - i) << self.low_bits) | self._low(i)

    def select_many(self, which: np.ndarray) -> np.ndarray:
        """Values at ``which``, each from the samples on either side of it: the high bits between those are counted by the byte."""
        which = np.asarray(which, np.int64)
        if not len(which):
            return np.zeros(0, np.int64)
        if which.min() < 0 or which.max() >= self.n:
            raise IndexError(which)
        ones = np.concatenate([[0], np.cumsum(_ONES[self.high], dtype=np.int64)])  # set bits before each byte
        sample = which // SAMPLE
        byte = self.samples[sample].astype(np.int64) // 8
        more = ones[byte + 1] <= which  # not in its sample's byte: in one up to the next sample's
        byte[more] = np.searchsorted(ones, which[more], "right") - 1
        bit = byte * 8 + _PLACE[self.high[byte], which - ones[byte]]
        return ((bit - which) << self.low_bits) | self._low_many(which)

    def _low_many(self, which: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(which), np.int64)
        out, first = np.zeros(len(which), np.int64), which * self.low_bits
        for k in range(self.low_bits):
            at = first + k
            out |= (self.low[at // 8].astype(np.int64) >> (at % 8) & 1) << k
        return out

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return (high << self.low_bits) | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def to_bytes(self) -> bytes:
        return struct.pack(
            "<QIQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)
        ) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, nl, nh, ns = struct.unpack_from("<QIQQQ", b, at)
        at += 36
        ends = at + nl, at + nl + nh, at + nl + nh + 4 * ns
        return cls(n, low_bits, b[at : ends[0]], b[ends[0] : ends[1]], b[ends[1] : ends[2]]), ends[2]


def _ones_in(byte: int) -> int:
    return _ONES[byte]


def pack_shard(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, width: int) -> bytes:
    """A shard: header, documents' ids and boundaries (both Elias-Fano), then all token ids at ``width`` bytes. Null document ids come first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return (
        MAGIC
        + struct.pack("<IQQqQ", width, len(doc_ids), len(ids), least, len(doc_ids) - len(known))
        + EliasFano.of(known - least).to_bytes()
        + EliasFano.of(bounds).to_bytes()
        + ids.astype(f"<u{width}").tobytes()
    )


class Shard:
    """What ``pack_shard`` wrote."""

    def __init__(self, b: bytes):
        if b[:8] != MAGIC:
            raise ValueError("not a token shard")
        width, self.n_docs, self.n_ids, self.least, self.n_null = struct.unpack_from("<IQQqQ", b, 8)
        self.known, at = EliasFano.from_bytes(b, 44)
        self.bounds, at = EliasFano.from_bytes(b, at)
        self.ids = np.frombuffer(b, f"<u{width}", self.n_ids, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.known.all() + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]
