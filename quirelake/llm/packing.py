"""Packing documents into sequences of a fixed capacity by cutting-stock column generation.

A document's ids are cut at multiples of the capacity; what remains has one of a few hundred length classes. A linear program over packing
patterns (how many pieces of each class a sequence holds) is solved by column generation: knapsack dynamic programming over the program's
dual prices finds each next pattern. Patterns are rounded down, what they leave is packed first-fit by falling length, and the pieces of
each class, ranked, fill the patterns' slots. Only the histogram of classes, whose size is fixed, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .scratch import cut
from .words import portions

CAPACITY, END_ID = 2048, 1


def classes(capacity: int) -> np.ndarray:
    """Lengths that pieces are rounded up to: every length to 32, then steps of a 32nd of the length at most, and of 8."""
    out, step, n = [], 1, 0
    while n < capacity:
        if n >= 32 * step and step < 8:
            step *= 2
        n = min(capacity, n + step)
        out.append(n)
    return np.array(out)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each capacity, the capacity at which it is first reached, and the item taken last there."""
    best, reached, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], reached[c] = best[c - 1], reached[c - 1]
        if k := upto[c]:
            v = best[c - sizes[:k]] + values[:k]
            i = v.argmax()
            if v[i] > best[c] + 1e-12:
                best[c], reached[c], last[c] = v[i], c, i
    return best, reached, last


def _taken(reached: np.ndarray, last: np.ndarray, sizes: np.ndarray, c: int) -> np.ndarray:
    out = np.zeros(len(sizes))
    while (c := reached[c]) > 0:
        out[last[c]] += 1
        c -= sizes[last[c]]
    return out


def greedy_patterns(counts: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """As many patterns as classes: the largest class left and the largest that still fit, used until one class is exhausted.

    Each pattern holds the class it exhausts and none exhausted before, so together they are a basis.
    """
    left, patterns, uses = counts.astype(float).copy(), [], []
    open_ = np.ones(len(sizes), bool)
    while open_.any():
        a, room = np.zeros(len(sizes)), capacity
        for i in np.flatnonzero(open_)[::-1]:
            if sizes[i] <= room:
                k = 1 if not a.any() else room // sizes[i]
                a[i], room = k, room - k * sizes[i]
        ratio = np.where(a > 0, left / np.where(a > 0, a, 1), np.inf)
        i = int(ratio.argmin())
        left -= ratio[i] * a
        open_[i], left[i] = False, 0
        patterns.append(a)
        uses.append(ratio[i])
    return np.array(patterns), np.maximum(np.array(uses), 0)


def column_generation(
    counts: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = 1e-3, most_rounds: int = 300
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, of the linear program's solution within ``gap`` of the optimum.

    Revised simplex: the basis starts with greedy patterns. Prices are smoothed between the program's duals and a piece's share
    of the capacity, the duals of a packing without waste. Any basis met is feasible, so the limit on rounds costs only padding.
    """
    patterns, x = greedy_patterns(counts, sizes, capacity)
    inverse = np.linalg.inv(patterns.T)
    duals = inverse.sum(0)
    share = sizes / capacity
    bound, weight = counts @ share, 0.7
    for _ in range(most_rounds):
        if x.sum() <= (1 + gap) * bound:
            break
        smooth = weight * share + (1 - weight) * np.maximum(duals, 0)
        best, reached, last = price(smooth, sizes, capacity)
        bound = max(bound, counts @ smooth / best[capacity])
        # besides the best pattern, the best with each class in it: many pivots for one pricing
        worth = smooth + best[capacity - sizes]
        tried = [_taken(reached, last, sizes, capacity)]
        for i in np.argsort(-(duals - share) - worth)[:64]:
            tried.append(_taken(reached, last, sizes, capacity - sizes[i]))
            tried[-1][i] += 1
        pivots = 0
        for a in tried:
            gain = duals @ a - 1
            if gain <= 1e-9:
                continue
            d = inverse @ a
            up = d > 1e-9
            if not up.any():
                continue
            ratio = np.where(up, x / np.where(up, d, 1), np.inf)
            r = int(ratio.argmin())
            x = x - ratio[r] * d
            x[r] = ratio[r]
            np.maximum(x, 0, out=x)
            row = inverse[r] / d[r]
            some = np.flatnonzero(d)
            inverse[some] -= d[some, None] * row
            inverse[r] = row
            patterns[r] = a
            duals = duals - gain * row
            pivots += 1
        if not pivots:
            if weight == 0:
                break
            weight = weight / 2 if weight > 0.05 else 0.0
    return patterns, x


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class length: pieces} with whole numbers of uses that hold exactly ``counts`` pieces of each class."""
    out = [({capacity: 1}, n)] if (n := counts.get(capacity, 0)) else []
    sizes = np.array(sorted(s for s, n in counts.items() if n and s < capacity), np.int64)
    if not len(sizes):
        return out
    have = np.array([counts[int(s)] for s in sizes], np.int64)
    patterns, x = column_generation(have.astype(float), sizes, capacity)
    left = have.copy()
    for a, uses in sorted(zip(patterns.astype(np.int64).tolist(), np.floor(x + 1e-6).astype(np.int64).tolist(), strict=True), key=lambda p: -p[1]):
        a = np.array(a)
        uses = min([uses, *(left[a > 0] // a[a > 0]).tolist()])
        if uses > 0:
            left -= uses * a
            out.append(({int(s): int(k) for s, k in zip(sizes, a, strict=True) if k}, int(uses)))
    bins: list[list] = []  # room, pattern
    for s, n in zip(sizes[::-1].tolist(), left[::-1].tolist(), strict=True):
        for b in bins:
            if not n:
                break
            if k := min(n, b[0] // s):
                b[0] -= k * s
                b[1][s] = k
                n -= k
        while n:
            k = min(n, capacity // s)
            bins.append([capacity - k * s, {s: k}])
            n -= k
    return out + [(p, 1) for _, p in bins]


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of each document, cut at multiples of the capacity; ``part`` and ``k`` number those of a class within a task."""
    kind, sizes = docs.schema[id_col].dataType.simpleString(), classes(capacity)
    more = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen = tokens.load(tokenizer), TaskContext.get().partitionId(), np.zeros(len(sizes), np.int64)
        for b in portions(batches, 1):
            rows, which = [], []
            for i, found in enumerate(tok.many(b.column(1))):
                ids = np.append(found, np.int32(end_id))
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    c = int(np.searchsorted(sizes, len(piece)))
                    rows.append(
                        (
                            at, len(piece), tokens.crc(piece), len(ids), int(sizes[c]), int(seen[c]),
                            piece.astype("<u4").tobytes() if with_ids else None
                        )
                    )
                    which.append(i)
                    seen[c] += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            names = ["start", "length", "ids_crc32", "doc_tokens", "size", "k"]
            out = [
                b.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array([part] * len(rows), pa.int64())
            ]
            yield pa.RecordBatch.from_arrays(
                out + ([pa.array(cols[6], pa.binary())] if with_ids else []), names=["id", *names, "part", *(["ids"] if with_ids else [])]
            )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, size long, k long, part long{more}"
    )


def pack(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset (and ``ids``, if asked for, as little-endian u32).

    A null text is empty and has the end id alone; ids may be null or repeat; an empty table packs into no sequence; other columns are not
    read. Equal lengths are told apart by task and order in it.
    """
    pieces = cut(pieces_of(docs, tokenizer or tokens.default_path(), id_col, text_col, capacity, end_id, with_ids), "pieces")
    by_part = cut(pieces.groupBy("part", "size").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["size"]: r["n"] for r in by_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # class: pieces before, pieces in a sequence, first sequence, slots before in it
    first, filled = 0, dict.fromkeys(counts, 0)
    for pattern, uses in plan(counts, capacity):
        for size, k in pattern.items():
            slots.setdefault(size, []).append((filled[size], k, first))
            filled[size] += k * uses
        first += uses
    table = {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in slots.items()}
    before = by_part.select(
        "part", "size",
        F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    ranked = pieces.join(before, ["part", "size"]).select(
        pieces["id"], "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("k")).alias("rank"),
        *(["ids"] if with_ids else [])
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("size", "rank"))
            seq, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(size):
                here = size == s
                lo, k, base = table[int(s)]
                at = np.searchsorted(lo, rank[here], "right") - 1
                q = rank[here] - lo[at]
                seq[here], slot[here] = base[at] + q // k[at], q % k[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], names=[*b.schema.names, "sequence_id", "slot"])

    placed = ranked.mapInArrow(place, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ranked.schema)}, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), *(["ids"] if with_ids else [])
    )
    return out
