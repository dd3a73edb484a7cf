"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark items' word windows. Blocks of two words are hashed into a shift table: a block in no pattern lets the search
pass over every window that it would lie in, so most words of a clean text are never looked at. Where the shift is zero, a hash of the last
words names the bucket of patterns that end so, and those are compared word by word. Many cursors run over a batch of texts at once in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .words import Numbering, alnum_words, portions, row_texts

WINDOW = 13
#: Bytes of benchmark texts that one automaton takes, about six times as many once built; beyond it the texts are searched once for each part of the benchmark.
MOST_BYTES = 16_000_000
STRETCH = 1024
#: Words at the end of a window whose hash picks the patterns to compare.
SUFFIX = 6


def _hash(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (
        (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
    ).astype(np.int64)


class _Search:
    """Patterns of one length m: runs of ``words`` (numbers, one item's after the other) that begin at ``at``, whose owners are ``items``.

    Equal patterns are held once, as the place of the first. The shift table has eight slots for each word that patterns are made of, so
    that most blocks of a text, which are in no pattern, fall on a free slot; suffix buckets are runs of the sorted hashes.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, items: np.ndarray, m: int):
        self.words, self.m, self.b = words, m, min(2, m)
        rank, have = words.astype(np.int32), 1  # of runs of ``have`` words, doubled up to m
        while have < m:
            step = min(have, m - have)
            left, right = rank[: len(rank) - step].astype(np.int64), rank[step:]
            left = left * (int(right.max()) + 1) + right
            rank = np.unique(left, return_inverse=True)[1].astype(np.int32)
            have += step
        _, first, which = np.unique(rank[at], return_index=True, return_inverse=True)
        del rank
        self.at = at[first].astype(np.int32)  # of each pattern
        order = np.lexsort((items, which))
        which, items = which[order], items[order]
        own = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(items) != 0)]))
        self.items = items[own].astype(np.int32)  # of all patterns, one pattern's after the other
        self.owned = np.searchsorted(which[own], np.arange(len(self.at) + 1)).astype(np.int32)
        self.bits = max(10, int(8 * max(1, len(at))).bit_length())
        small = np.int8 if m < 128 else np.int32
        self.shift = np.full(1 << self.bits, m - self.b + 1, small)
        for end in range(m - 1, self.b - 2, -1):
            h = _hash(words[self.at + end - self.b + 1], words[self.at + end], self.bits)
            self.shift[h] = np.minimum(self.shift[h], small(m - 1 - end))
        suffix = self._suffix(words, self.at + m - 1)
        self.bucket = np.argsort(suffix, kind="stable").astype(np.int32)
        self.suffix = suffix[self.bucket]

    def _suffix(self, w: np.ndarray, end: np.ndarray) -> np.ndarray:
        """32-bit hashes of the last words, SUFFIX of them at most, that end at ``end``."""
        h = np.zeros(len(end), np.uint64)
        for k in range(min(SUFFIX, self.m)):
            h = (h + w[end - k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return (h >> np.uint64(32)).astype(np.uint32)

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last positions and pattern numbers of all occurrences in ``w``."""
        none = np.zeros(0, np.int64)
        if len(w) < self.m:
            return none, none
        at = np.arange(self.m - 1, len(w), STRETCH)
        end = np.minimum(at + STRETCH, len(w))
        ends, found = [none], [none]
        back = np.arange(1 - self.m, 1)
        while len(at):
            h = _hash(w[at - self.b + 1], w[at], self.bits)
            step = self.shift[h]
            hit = step == 0
            if hit.any():
                e = at[hit]
                h = self._suffix(w, e)
                k, last = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
                some = k < last
                e, k, last = e[some], k[some], last[some]
                while len(e):
                    p = self.bucket[k]
                    same = (w[e[:, None] + back] == self.words[self.at[p][:, None] + back + self.m - 1]).all(1)
                    ends.append(e[same])
                    found.append(p[same].astype(np.int64))
                    k = k + 1
                    more = k < last
                    e, k, last = e[more], k[more], last[more]
            at = at + np.maximum(step, 1)
            go = at < end
            at, end = at[go], end[go]
        return np.concatenate(ends), np.concatenate(found)


class Benchmark:
    """Automata for the windows of (item, text) pairs, one for each window length. Words and windows are numbers in arrays."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocab = Numbering()
        self.vocab[b""] = 0  # no word: what isn't in the vocabulary
        self.names: list[str | None] = []
        words, at, owner, total = [], {}, {}, 0
        for item, text in items:
            ids = self.vocab.of(alnum_words((text or "").encode())).astype(np.int32)
            n = min(window, len(ids))
            if n:
                at.setdefault(n, []).append(np.arange(total, total + len(ids) - n + 1, dtype=np.int32))
                owner.setdefault(n, []).append(np.full(len(ids) - n + 1, len(self.names), np.int32))
                words.append(ids)
                total += len(ids)
                self.names.append(item)
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.parts = [_Search(flat, np.concatenate(at[n]), np.concatenate(owner[n]), n) for n in sorted(at)]
        self.vocab = dict(self.vocab)

    def scan(self, batch: Iterable[bytes]) -> list[tuple[int, np.ndarray, list]]:
        """For each text: how many words, which of them (as half-open ranges, flattened) are in an occurrence, and the items that occur."""
        known = self.vocab.get
        numbers, sizes = [], []
        for t in batch:
            words = alnum_words(t)
            sizes.append(len(words))
            numbers.append(np.fromiter(map(known, words, repeat(0)), np.int32, len(words)))
            numbers.append(_GAP)  # no window runs from one text into the next
        w, n = np.concatenate(numbers) if numbers else _GAP[:0], np.array(sizes, np.int64)
        starts = np.concatenate([[0], np.cumsum(n + 1)])
        edge, items = np.zeros(len(w) + 1, np.int32), {}
        for search in self.parts:
            ends, found = search.find(w)
            np.add.at(edge, ends - search.m + 1, 1)
            np.add.at(edge, ends + 1, -1)
            if len(ends):
                of = np.unique((np.searchsorted(starts, ends, "right") - 1) * len(search.at) + found)
                for d, p in zip((of // len(search.at)).tolist(), (of % len(search.at)).tolist(), strict=True):
                    items.setdefault(d, set()).update(search.items[search.owned[p] : search.owned[p + 1]].tolist())
        inside = np.cumsum(edge[:-1]) > 0
        out = []
        for d, (lo, size) in enumerate(zip(starts[:-1].tolist(), sizes, strict=True)):
            if d in items:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], inside[lo : lo + size].astype(np.int8), [0]])))
                out.append((size, turn, sorted({str(self.names[i]) for i in items[d] if self.names[i] is not None})))
            else:
                out.append((size, turn_none, []))
        return out


_GAP = np.zeros(1, np.int32)
turn_none = np.zeros(0, np.int64)


def hit_words(ranges: np.ndarray) -> int:
    return int((ranges[1::2] - ranges[::2]).sum())


def is_contaminated(n_words: int, n_hit: int, share: int = 20) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def _parts(benchmark: DataFrame, most_bytes: int) -> list:
    """The benchmark's texts in parts of about ``most_bytes``: for each, its rows when asked for."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(size / most_bytes))
    return [lambda k=k: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()] for k in range(n)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted strings) and contaminated.

    ``benchmark`` has item_id and text. A null text has no words, on either side; items without words have no window; an empty benchmark
    hits nothing; a very long text is searched whole; ids may be null or repeat (an item's null id counts its hits but is not listed); an
    empty table gives an empty result; other columns are not read.
    """
    kind, spark = docs.schema[id_col].dataType.simpleString(), docs.sparkSession
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    parts = _parts(benchmark, most_bytes)
    if len(parts) == 1:
        held = spark.sparkContext.broadcast(Benchmark(parts[0](), window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in portions(batches, 1):
                rows = [(n, hit_words(r), items) for n, r, items in held.value.scan(row_texts(b.column(1)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([is_contaminated(r[0], r[1]) for r in rows], pa.bool_())
                    ],
                    names=["id", "n_words", "n_hit", "items", "contaminated"],
                )

        out = plain.mapInArrow(run, f"id {kind}, n_words long, n_hit long, items array<string>, contaminated boolean")
    else:
        out = _by_parts(plain, parts, kind, window)
    return out.withColumnRenamed("id", id_col)


def _by_parts(plain: DataFrame, parts: list, kind: str, window: int) -> DataFrame:
    """A benchmark too large for one automaton: a search for each part, then each row's ranges and items united."""
    spark, found = plain.sparkSession, []
    rows = cut(plain.withColumn("row", F.monotonically_increasing_id()), "searched")
    for part in parts:
        held = spark.sparkContext.broadcast(Benchmark(part(), window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in portions(batches, 1):
                got = held.value.scan(row_texts(b.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64())),
                        pa.array([g[2] for g in got], pa.list_(pa.string()))
                    ],
                    names=["row", "n_words", "ranges", "items"]
                )

        found.append(cut(rows.select("row", "text").mapInArrow(run, "row long, n_words long, ranges array<long>, items array<string>"), "found"))
        held.unpersist()
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    each = union.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.collect_list("ranges").alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for n, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                edge = np.zeros(n + 1, np.int32)
                for r in ranges:
                    np.add.at(edge, r[::2], 1)
                    np.add.at(edge, r[1::2], -1)
                hits.append(int((np.cumsum(edge) > 0).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array(hits, pa.int64()), b.column(3),
                    pa.array([is_contaminated(n, h) for n, h in zip(b.column(1).to_pylist(), hits, strict=True)], pa.bool_())
                ],
                names=["row", "n_words", "n_hit", "items", "contaminated"]
            )

    return rows.select("row", "id").join(
        each.mapInArrow(unite, "row long, n_words long, n_hit long, items array<string>, contaminated boolean"), "row"
    ).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns as they are.

    Null and empty texts have no words and stay; a very long text is searched whole; repeated rows are judged alike, each by itself; ids don't
    matter; an empty benchmark drops nothing; an empty table stays empty. Only the texts go to Python, and one verdict a row comes back.
    """
    parts = _parts(benchmark, most_bytes)
    if len(parts) > 1:
        rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "searched")
        keep = contamination(rows, benchmark, "__row", text_col, window, most_bytes).where(~F.col("contaminated")).select("__row")
        return rows.join(keep, "__row").drop("__row")
    held = docs.sparkSession.sparkContext.broadcast(Benchmark(parts[0](), window))

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for b in portions([pa.RecordBatch.from_arrays([column], names=["text"])], 0):
            out += [not is_contaminated(n, hit_words(r)) for n, r, _ in held.value.scan(row_texts(b.column(0)))]
        return pa.array(out, pa.bool_())

    return docs.where(clean(F.col(text_col)))
