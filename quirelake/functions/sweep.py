"""Pairs of boxes of many pages at a time, and on crowded pages by a sweep: what a page of many thousand boxes needs instead of comparing all with all.

Boxes are sorted along one axis. Those whose stretch meets a box's own either begin within it or hold its beginning, and both are runs of the
sorted beginnings, so only pairs that meet along the axis are ever made; of the two axes the one with fewer such pairs is taken. Common
pages are compared all with all, the pages of a batch together. Column expressions handle the smallest pages and send nulls here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Pages with up to so many pairs of boxes are compared by column expressions: where the pairs stay in the page's row, and where each is a row.
SMALL, SMALL_AS_ROWS = 16, 64
#: Pages with more pairs are swept.
CROWDED = 4096
#: Pairs that are looked at at a time.
BLOCK = 1 << 21


def boxes(row: list | None) -> np.ndarray:
    """An array of boxes, one a row; one that isn't four numbers meets nothing."""
    return np.array([b if b is not None and len(b) == 4 and None not in b else [np.nan] * 4 for b in row or []], np.float64).reshape(-1, 4)


def _runs(first: np.ndarray, last: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, every place from first[k] to last[k] - 1), in blocks."""
    sizes = np.maximum(last - first, 0)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + block, "right")))
        n = sizes[lo:hi]
        if n.sum():
            k = np.repeat(np.arange(lo, hi), n)
            yield k, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[k]
        lo = hi


def meeting(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` of all pairs whose insides meet, in blocks, in no order."""
    ways = []
    for lo, hi in ((1, 3), (0, 2)):
        order_a, order_b = np.argsort(a[:, lo], kind="stable"), np.argsort(b[:, lo], kind="stable")
        from_b, from_a = b[order_b, lo], a[order_a, lo]
        # b begins within a; a begins within b, after its beginning
        one = np.searchsorted(from_b, a[:, lo], "left"), np.searchsorted(from_b, a[:, hi], "left")
        two = np.searchsorted(from_a, b[:, lo], "right"), np.searchsorted(from_a, b[:, hi], "left")
        pairs = int(np.maximum(one[1] - one[0], 0).sum() + np.maximum(two[1] - two[0], 0).sum())
        ways.append((pairs, order_a, order_b, one, two))
    _, order_a, order_b, one, two = min(ways, key=lambda w: w[0])
    for swapped, order, (first, last) in ((False, order_b, one), (True, order_a, two)):
        for k, place in _runs(first, last):
            i, j = (order[place], k) if swapped else (k, order[place])
            x, y = a[i], b[j]
            ok = (x[:, 1] < y[:, 3]) & (y[:, 1] < x[:, 3]) & (x[:, 0] < y[:, 2]) & (y[:, 0] < x[:, 2])
            yield i[ok], j[ok]


def overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The page metric's overlap, as the column expression has it."""
    w, h = np.minimum(x[:, 2], y[:, 2]) - np.maximum(x[:, 0], y[:, 0]), np.minimum(x[:, 3], y[:, 3]) - np.maximum(x[:, 1], y[:, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    union = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) + (y[:, 2] - y[:, 0]) * (y[:, 3] - y[:, 1]) - inter
    return np.divide(inter, union, out=np.zeros(len(x)), where=(inter > 0) & (union > 0))


def one_to_one(i: list[int], j: list[int], ok: list[bool] | None = None) -> list[int]:
    """Places of the pairs that are taken in turn, each of whose sides is still free."""
    taken_i, taken_j, out = set(), set(), []
    for k, (x, y) in enumerate(zip(i, j, strict=True)):
        if (ok is None or ok[k]) and x not in taken_i and y not in taken_j:
            taken_i.add(x)
            taken_j.add(y)
            out.append(k)
    return out


def flat(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of an array of lists of boxes, one a row, and where each list begins and the last ends; as ``boxes`` has them."""
    each = rows.flatten()
    sizes, values = _sizes(each), each.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    whole = sizes == 4
    out = np.full((len(each), 4), np.nan)
    first = (np.cumsum(sizes) - sizes)[whole]
    out[whole] = values[first[:, None] + np.arange(4)]
    out[np.isnan(out).any(1)] = np.nan
    return out, _bounds(_sizes(rows))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def meeting_on_pages(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``meeting`` for many pages, whose boxes are the stretches of ``a`` and ``b`` between ``of_a`` and ``of_b``. Those of common pages are set against
    one another together, all with all; a crowded page is swept."""
    n_a, n_b = np.diff(of_a), np.diff(of_b)
    crowded = n_a * n_b > CROWDED
    for k in np.flatnonzero(crowded):
        for i, j in meeting(a[of_a[k] : of_a[k + 1]], b[of_b[k] : of_b[k + 1]]):
            yield i + of_a[k], j + of_b[k]
    first, last = of_b[:-1], np.where(crowded, of_b[:-1], of_b[1:])
    for i, j in _runs(np.repeat(first, n_a), np.repeat(last, n_a), BLOCK >> 5):
        x, y = a[i], b[j]
        ok = (x[:, 1] < y[:, 3]) & (y[:, 1] < x[:, 3]) & (x[:, 0] < y[:, 2]) & (y[:, 0] < x[:, 2])
        yield i[ok], j[ok]


def overlapping_on_pages(
    a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, least: np.ndarray, strictly: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(overlap, i, j, bounds) of pairs that reach their page's ``least`` (over 0): page by page, by falling overlap, then by i and j, which are places
    within the page."""
    found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    page = np.repeat(np.arange(len(of_a) - 1), np.diff(of_a))
    for i, j in meeting_on_pages(a, of_a, b, of_b):
        o = overlap(a[i], b[j])
        ok = o > least[page[i]] if strictly else o >= least[page[i]]
        found.append((o[ok], i[ok], j[ok]))
    o, i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((j, i, -o, page[i]))
    o, i, j = o[order], i[order], j[order]
    on = page[i]
    return o, i - of_a[on], j - of_b[on], np.searchsorted(on, np.arange(len(of_a)))


def _lists(bounds: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    """Lists of ``values``, null where ``like`` is."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=like.is_null())


def _structs(**columns: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.float64() if c.dtype == np.float64 else pa.int32()) for c in columns.values()], list(columns))


def _numbers(a: pa.Array) -> np.ndarray:
    """Numbers, NaN for nulls: nothing reaches that."""
    return a.to_numpy(zero_copy_only=False).astype(np.float64)


_PAIRS = from_arrow_type(pa.list_(pa.struct([("gi", pa.int32()), ("pi", pa.int32())])))
_RANKED = from_arrow_type(pa.list_(pa.struct([("o", pa.float64()), ("gi", pa.int32()), ("pi", pa.int32())])))
_PLACES = from_arrow_type(pa.list_(pa.list_(pa.int32())))
_STAYS = from_arrow_type(pa.list_(pa.list_(pa.bool_())))


@F.arrow_udf(_PAIRS)
def greedy_large(gt: pa.Array, pred: pa.Array, least: pa.Array) -> pa.Array:
    _, i, j, bounds = overlapping_on_pages(*flat(gt), *flat(pred), _numbers(least))
    x, y, taken = i.tolist(), j.tolist(), [0]
    places = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        places += [lo + k for k in one_to_one(x[lo:hi], y[lo:hi])]
        taken.append(len(places))
    return _lists(np.array(taken), _structs(gi=i[places], pi=j[places]), gt)


@F.arrow_udf(_RANKED)
def pairs_large(gt: pa.Array, pred: pa.Array, least: pa.Array) -> pa.Array:
    o, i, j, bounds = overlapping_on_pages(*flat(gt), *flat(pred), _numbers(least))
    return _lists(bounds, _structs(o=-o, gi=i, pi=j), gt)


@F.arrow_udf(_PLACES)
def later_large(rows: pa.Array) -> pa.Array:
    """For each box the later ones that it meets."""
    b, bounds = flat(rows)
    found = [np.zeros((0, 2), np.int64), *(np.stack([i, j], 1)[i < j] for i, j in meeting_on_pages(b, bounds, b, bounds))]
    i, j = np.concatenate(found).T
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    first = bounds[np.searchsorted(bounds, i, "right") - 1]
    each = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(b) + 1)), pa.int32()), pa.array(j - first, pa.int32()))
    return _lists(bounds, each, rows)


@F.arrow_udf(_STAYS)
def stays_large(rows: pa.Array, kinds: pa.Array, confs: pa.Array, limits: pa.Array) -> pa.Array:
    """For each limit which boxes stay when each, by falling confidence and then by place, removes those of its kind that overlap it by more than that."""
    b, bounds = flat(rows)
    sizes, many = np.diff(bounds), _sizes(limits)
    page = np.repeat(np.arange(len(sizes)), sizes)
    kind = pc.fill_null(kinds.flatten().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    order = np.lexsort((np.arange(len(b)), -_numbers(confs.flatten()), page))
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(len(b))
    at = limits.to_pylist()
    least = np.array([min(x) if x else np.nan for x in at], np.float64)
    o, i, j, ends = overlapping_on_pages(b, bounds, b, bounds, least, strictly=True)
    on = np.repeat(np.arange(len(sizes)), np.diff(ends))
    x, y = i + bounds[on], j + bounds[on]
    ok = (rank[x] < rank[y]) & (kind[x] == kind[y])
    o, i, j, x, y, on = o[ok], i[ok], j[ok], x[ok], y[ok], on[ok]
    order = np.lexsort((rank[y], rank[x]))  # page by page; a box's fate is known before its own turn comes
    ends = np.searchsorted(on, np.arange(len(sizes) + 1)).tolist()
    o, i, j = o[order].tolist(), i[order].tolist(), j[order].tolist()
    out = []
    for k, (n, wanted) in enumerate(zip(sizes.tolist(), at, strict=True)):
        for limit in wanted or ():
            stays = [True] * n
            for z in range(ends[k], ends[k + 1]):
                if o[z] > limit and stays[i[z]]:
                    stays[j[z]] = False
            out.append(stays)
    return _lists(_bounds(many), pa.array(out, pa.list_(pa.bool_())), rows)


@F.arrow_udf(_PLACES)
def taken_large(pairs: pa.Array, kept: pa.Array, least: pa.Array) -> pa.Array:
    """For each point the places of the pairs that it takes, of those whose second box it keeps and whose overlap reaches its least."""
    each, bounds = pairs.flatten(), _bounds(_sizes(pairs)).tolist()
    i, j, o = (each.field(c).to_numpy(zero_copy_only=False) for c in ("gi", "pi", "o"))
    keeps = kept.flatten()
    starts, of_page = (_bounds(_sizes(c)).tolist() for c in (keeps, kept))
    keeps, at = keeps.flatten().to_numpy(zero_copy_only=False).astype(bool), least.to_pylist()
    out = []
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        x, y, v = i[lo:hi].tolist(), j[lo:hi], -o[lo:hi]
        for n in range(of_page[k], of_page[k + 1]):
            out.append(one_to_one(x, y.tolist(), ((v >= at[k][n - of_page[k]]) & keeps[starts[n] : starts[n + 1]][y]).tolist()))
    return _lists(np.array(of_page), pa.array(out, pa.list_(pa.int32())), pairs)


def of_boxes(regions: Column) -> Column:
    return regions.getField("bbox")


def is_large(a: Column, b: Column, small: int | None = None) -> Column:
    """Whether boxes make more pairs than ``small``, by default SMALL."""
    return F.size(a).cast("long") * F.size(b) > (SMALL if small is None else small)
