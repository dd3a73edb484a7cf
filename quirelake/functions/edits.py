"""Edit distances of long texts, by bits: a column of the table of distances is held as the bits of two whole numbers, one set where the
distance grows by one from a character to the next and one where it falls (Myers 1999, with the horizontal differences of Hyyrö 2003), so that
a character of one text costs a few operations on a number of as many bits as the other text has characters. The built-in function, which
fills the table cell by cell, stays for short texts.

The texts of a batch go together: numbers are cut into words of 64 bits, and one word of every pair is a row of an array. A word takes from the
one before it only whether the distance at their border grew or fell, so in each step every word is one character behind the word before it, and
all words of all pairs are one operation. Only words near the diagonal are computed; that is exact for pairs whose distance turns out to be
within what the band allows, and the others are computed again with a band of twice the width.
"""

from __future__ import annotations

import os.path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Pairs of texts whose lengths multiply to no more are left to the built-in function.
CELLS = 1 << 14
#: Pairs that are compared together: at least and at most, texts up to so many characters and with so many different ones; together with so many
#: characters at most. Others are compared by ``distance``.
FEW, MANY, LONGEST, LETTERS, TOGETHER = 12, 512, 4096, 512, 1 << 19
#: Pairs that are sorted by length at a time.
SLICE = 4096
#: First width of the band beside the diagonal, as a part of the texts' length.
PART = 8


def distance(a: str, b: str) -> int:
    """Least number of characters inserted, removed or replaced that make ``a`` of ``b``."""
    if a == b:
        return 0
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, bytearray] = {}
    size = (len(a) + 7) // 8
    for i, c in enumerate(a):
        if c not in places:
            places[c] = bytearray(size)
        places[c][i >> 3] |= 1 << (i & 7)
    at = {c: int.from_bytes(bits, "little") for c, bits in places.items() if c in b}
    every = (1 << len(a)) - 1
    grows, falls = every, 0
    for c in b:
        equal = at.get(c, 0)
        # where the distance stays along the diagonal; then what it does from one character of b to the next
        stays = ((((equal & grows) + grows) ^ grows) | equal | falls) & every
        more = ((falls | (every ^ (stays | grows))) << 1) | 1
        falls, grows = stays & more, (((grows & stays) << 1) | (every ^ (stays | more))) & every
    # the last column starts at the length of b and goes by its bits
    return len(b) + grows.bit_count() - falls.bit_count()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _apart(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Both texts without what they begin and end with alike, the longer one first."""
    x, y = _codes(a), _codes(b)
    for _ in range(2):  # the beginnings, then the ends as beginnings of what is reversed
        n = min(len(x), len(y))
        unlike = np.flatnonzero(x[:n] != y[:n])
        same = int(unlike[0]) if len(unlike) else n
        x, y = x[same:][::-1], y[same:][::-1]
    return (x, y) if len(x) >= len(y) else (y, x)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], part: float) -> tuple[np.ndarray, np.ndarray]:
    """A distance for each pair (the longer one first), and whether it is known to be the least one; else it is an upper bound."""
    count, m, n = len(pairs), *(np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    words = (int(m.max()) + 63) // 64
    # all first texts get one length by a character that neither has; the second ones get as many at their ends, so distances stay
    columns = n + 64 * words - m
    last = int(columns.max())
    first, second = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    letters = np.unique(first)
    known = len(letters)
    number = np.full(max(int(first.max()), int(second.max())) + 1, known + 1)
    number[letters] = np.arange(known)
    rows = np.full((count, 64 * words), known)
    rows[np.arange(64 * words) < m[:, None]] = number[first]
    text = np.full((count, last), known + 1)
    at = np.arange(last)
    text[at < columns[:, None]] = known
    text[at < n[:, None]] = number[second]
    # where each letter stands in each first text: a word for each 64 characters
    of_pair = np.arange(count)[:, None] * (known + 2)
    places = np.zeros(count * (known + 2) * words, np.uint64)
    at = np.arange(64 * words)
    np.bitwise_or.at(places, (of_pair + rows) * words + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    # backwards, with nothing before and after the text, so that a step's words, each a character behind the one before, are a slice
    reading = np.full((last + 2 * words, count), 1) * ((of_pair.T + known + 1) * words)
    reading[words : words + last] = ((of_pair + text) * words).T[::-1]
    word = np.arange(words)[:, None]

    over = max(1, int(64 * words * part))  # the band: as far over the diagonal of the beginnings, and under that of the ends
    under = over + int((m - n).max())
    one, top = np.uint64(1), np.uint64(63)
    grows, falls = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    more, less, more_next, less_next = (np.zeros((words + 1, count), np.uint64) for _ in range(4))
    more[0] = more_next[0] = one
    buffers = [np.empty((words, count), np.uint64) for _ in range(5)]
    where = np.empty((words, count), np.int64)
    score, out, upto, above = np.full(count, 64), np.zeros(count, np.int64), 0, 0
    ends = columns + words - 2
    ending = {int(s): np.flatnonzero(ends == s) for s in np.unique(ends)}
    for s in range(last + words - 1):
        lo, hi = max(0, -((63 + over - s) // 65)), min(words, min(s, (s + under) // 65) + 1)
        if hi > upto:
            if upto:  # the score goes by the end of the last word that has begun
                score += 64 - (more[upto].view(np.int64) - less[upto].view(np.int64))
            upto = hi
        if lo and lo == above:  # over the band distances grow; the word that has just left it still says what its last character did
            more[lo], less[lo] = one, 0
        above = lo
        place = np.add(reading[last + words - 1 - s + lo : last + words - 1 - s + hi], word[lo:hi], out=where[lo:hi])
        equal, x, y, up, down = (b[lo:hi] for b in buffers)
        g, f, inc, dec = grows[lo:hi], falls[lo:hi], more[lo:hi], less[lo:hi]
        np.take(places, place, out=equal, mode="clip")
        np.bitwise_or(equal, f, out=y)
        np.bitwise_or(equal, dec, out=equal)
        np.bitwise_and(equal, g, out=x)
        np.add(x, g, out=x)
        np.bitwise_xor(x, g, out=x)
        np.bitwise_or(x, equal, out=x)  # where the distance stays along the diagonal
        np.bitwise_or(x, g, out=up)
        np.invert(up, out=up)
        np.bitwise_or(up, f, out=up)
        np.bitwise_and(g, x, out=down)
        np.right_shift(up, top, out=more_next[lo + 1 : hi + 1])
        np.right_shift(down, top, out=less_next[lo + 1 : hi + 1])
        np.left_shift(up, one, out=up)
        np.bitwise_or(up, inc, out=up)
        np.left_shift(down, one, out=down)
        np.bitwise_or(down, dec, out=down)
        np.bitwise_or(y, up, out=x)
        np.invert(x, out=x)
        np.bitwise_or(x, down, out=g)
        np.bitwise_and(up, y, out=f)
        more, more_next, less, less_next = more_next, more, less_next, less
        score += more[upto].view(np.int64) - less[upto].view(np.int64)
        if s in ending:
            out[ending[s]] = score[ending[s]]
    return out, ((out - (m - n)) // 2 <= over) & ((out + (m - n)) // 2 <= under)


def distances(pairs: list[tuple[str, str]]) -> list[int]:
    """``distance`` of each pair."""
    return [d for lo in range(0, len(pairs), SLICE) for d in _distances_of_slice(pairs[lo : lo + SLICE])]


def _distances_of_slice(pairs: list[tuple[str, str]]) -> list[int]:
    out, todo = [0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        if a == b:
            continue
        if max(len(a), len(b)) > LONGEST:
            out[k] = distance(a, b)
            continue
        x, y = _apart(a, b)
        if len(y):
            todo.append((k, x, y))
        else:
            out[k] = len(x)
    part = 1 / PART
    while todo:
        todo.sort(key=lambda t: ((len(t[1]) + 63) // 64, len(t[1]) - len(t[2])))
        again, lo = [], 0
        while lo < len(todo):
            most = len(todo[lo][1]) * 5 // 4 + 64  # texts of about one length go together
            hi = lo + 1
            while hi < len(todo) and hi - lo < MANY and len(todo[hi][1]) <= min(most, TOGETHER // (hi - lo + 1)):
                hi += 1
            mine, lo = todo[lo:hi], hi
            if len(mine) < FEW or len(np.unique(np.concatenate([x for _, x, _ in mine]))) > LETTERS:
                for k, _, _ in mine:
                    out[k] = distance(*pairs[k])
                continue
            found, sure = _banded([(x, y) for _, x, y in mine], part)
            for t, d, ok in zip(mine, found.tolist(), sure.tolist(), strict=True):
                if ok:
                    out[t[0]] = d
                else:
                    again.append(t)
        todo, part = again, part * 2
    return out


@F.arrow_udf(IntegerType())
def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    both = list(zip(a.to_pylist(), b.to_pylist(), strict=True))
    there = [x is not None and y is not None for x, y in both]
    found = iter(distances([p for p, ok in zip(both, there, strict=True) if ok]))
    return pa.array([next(found) if ok else None for ok in there], pa.int32())


def edit_distance(a: Column, b: Column) -> Column:
    """``levenshtein`` of two texts, null if one is: by bits where the texts are long, else by the built-in function. Equal texts leave neither."""
    cells = F.length(a).cast("long") * F.length(b)
    long = (a != b) & (cells > CELLS)
    by_bits = _distances(F.when(long, a), F.when(long, b))
    return F.when(a == b, 0).when(long, by_bits).otherwise(F.levenshtein(a, b))


@F.arrow_udf(ArrayType(IntegerType()))
def _distances_of_each(texts: pa.Array, b: pa.Array) -> pa.Array:
    rows = list(zip(texts.to_pylist(), b.to_pylist(), strict=True))
    found = iter(distances([(x, y) for row, y in rows if row is not None and y is not None for x in row if x is not None]))
    each = [None if row is None or y is None else [None if x is None else next(found) for x in row] for row, y in rows]
    return pa.array(each, pa.list_(pa.int32()))


def edit_distances(texts: Column, b: Column) -> Column:
    """``edit_distance`` of every text of an array to ``b``. By bits where the texts together are long."""
    together = F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))
    long = together * F.length(b) > CELLS
    by_bits = _distances_of_each(F.when(long, texts), F.when(long, b))
    return F.when(long, by_bits).otherwise(F.transform(texts, lambda t: F.levenshtein(t, b)))
