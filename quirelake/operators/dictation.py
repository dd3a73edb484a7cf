"""Known texts: recognised lines aligned with the text that was dictated, and sentences made of a corpus's own words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .curation import ranked

_WORD = re.compile(r"\w+")


#: Blocks of up to so many pairs of words keep all their rows, two bits a pair; larger ones are cut in two first.
CELLS = 1 << 27
#: Bytes of words' places that are kept between uses.
KEPT = 1 << 25


def _places(b: list[int]) -> Callable[[int], int]:
    """Gives the places of a word in ``b`` as the bits of a number."""
    lists: dict[int, list[int]] = {}
    for i, word in enumerate(b):
        lists.setdefault(word, []).append(i)
    made: dict[int, int] = {}
    size = (len(b) + 7) // 8

    def of(word: int) -> int:
        if word in made:
            return made[word]
        if word not in lists:
            return 0
        bits = bytearray(size)
        for i in lists[word]:
            bits[i >> 3] |= 1 << (i & 7)
        number = int.from_bytes(bits, "little")
        if len(made) * size < KEPT:
            made[word] = number
        return number

    return of


def _rows(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """For each beginning of ``a``, none first, where its edit distance from ``b``'s beginnings grows and falls by one from a word of ``b`` to the
    next, as bits of two numbers (as in ``functions.edits``)."""
    places, every = _places(b), (1 << len(b)) - 1
    grows, falls = every, 0
    yield grows, falls
    for word in a:
        equal = places(word)
        down = equal | falls
        across = ((((equal & grows) + grows) ^ grows) | equal) & every
        more, less = falls | (every ^ (across | grows)), grows & across
        more, less = ((more << 1) | 1) & every, (less << 1) & every
        grows, falls = less | (every ^ (down | more)), more & down
        yield grows, falls


def _bits(number: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes((n + 7) // 8, "little"), np.uint8), count=n, bitorder="little").astype(np.int64)


def _last_row(a: list[int], b: list[int]) -> np.ndarray:
    """Edit distances, in words, of ``a`` from every beginning of ``b``."""
    for grows, falls in _rows(a, b):  # noqa: B007
        pass
    return len(a) + np.concatenate([[0], np.cumsum(_bits(grows, len(b)) - _bits(falls, len(b)))])


def _distance(a: list[int], b: list[int]) -> int:
    if a == b:
        return 0
    for grows, falls in _rows(a, b):  # noqa: B007
        pass
    return len(a) + grows.bit_count() - falls.bit_count()


def _first_places(a: list[int], b: list[int]) -> list[int]:
    """The first place of ``b`` that any best alignment has before each word of ``a``, and after the last: back from the end, words of ``b`` are
    passed over wherever that is best, and words of ``a`` only where nothing else is."""
    rows = list(_rows(a, b))
    first, j = [0] * (len(a) + 1), len(b)
    for i in range(len(a), 0, -1):
        grows = rows[i][0]
        while j and grows >> (j - 1) & 1:
            j -= 1
        first[i] = j
        if j and (a[i - 1] == b[j - 1] or not rows[i - 1][1] >> (j - 1) & 1):
            j -= 1
    return first


def cuts(a: list[int], b: list[int], at: list[int]) -> list[int]:
    """Where a best alignment of words ``a`` with ``b`` stands in ``b`` before each of the places ``at`` (rising) of ``a``: the first such place.

    Blocks of over ``CELLS`` pairs are cut at the middle of ``at``, where the distances of both halves from ``b``'s beginnings and ends add up to
    least; best alignments through first places are best, so smaller blocks give the same places in one pass. Memory is linear in the words
    beyond ``CELLS``, time goes by their product, a word against a whole number's bits at once.
    """
    out, todo = [0] * len(at), [(0, len(a), 0, len(b), 0, len(at))]
    while todo:
        a0, a1, b0, b1, k0, k1 = todo.pop()
        if k0 >= k1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        if len(x) * len(y) <= CELLS:
            first = _first_places(x, y)
            for k in range(k0, k1):
                out[k] = b0 if b0 == b1 or at[k] <= a0 else b1 if at[k] >= a1 else b0 + first[at[k] - a0]
            continue
        k = (k0 + k1) // 2
        middle = max(a0, min(at[k], a1))
        if middle in (a0, a1):
            cut = b0 if middle == a0 else b1
        else:
            ahead = _last_row(x[: middle - a0], y)
            behind = _last_row(x[middle - a0 :][::-1], y[::-1])[::-1]
            cut = b0 + int(np.argmin(ahead + behind))
        out[k] = cut
        todo += [(a0, middle, b0, cut, k0, k), (middle, a1, cut, b1, k + 1, k1)]
    return out


def aligned(lines: list[str | None], text: str | None) -> list[tuple[int, int, int]]:
    """(first word, word after the last, edit distance in words) of the stretch of ``text`` that each line stands for, in order and without gaps.

    Words are runs of letters and digits, in lower case. The sum of the distances is the least that any such stretches have.
    """
    numbers: dict[str, int] = {}
    of = lambda t: [numbers.setdefault(w, len(numbers)) for w in _WORD.findall((t or "").lower())]
    parts, known = [of(t) for t in lines], of(text)
    if not parts:
        return []
    at = list(accumulate(map(len, parts)))
    ends = [*cuts(list(chain.from_iterable(parts)), known, at[:-1]), len(known)]
    return [(lo, hi, _distance(p, known[lo:hi])) for p, lo, hi in zip(parts, [0, *ends[:-1]], ends, strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))


@F.arrow_udf(from_arrow_type(_SPANS))
def _align(lines: pa.Array, texts: pa.Array) -> pa.Array:
    rows = zip(lines.to_pylist(), texts.to_pylist(), strict=True)
    return pa.array([None if x is None else [dict(zip(("start", "end", "distance"), s, strict=True)) for s in aligned(x, t)] for x, t in rows], _SPANS)


def align_lines(rows: DataFrame, lines: str = "lines", text: str = "text") -> DataFrame:
    """``rows`` with ``spans``: for each recognised line of the array ``lines`` the stretch of the known ``text`` that it stands for.

    Lines keep their order, stretches follow one another and cover the text; a line's distance says how far it is to be trusted. Null lines
    are empty, a null text has no words, a null array has no spans.
    """
    return rows.withColumn("spans", _align(F.col(lines), F.col(text)))


def line_targets(aligned_rows: DataFrame, most: float = 0.3, text: str = "text") -> DataFrame:
    """line (place), target and distance of lines whose distance is at most ``most`` of their stretch's words, beside the other columns."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))
    rest = [c for c in aligned_rows.columns if c not in ("spans", "lines", text)]
    each = aligned_rows.withColumn("__w", words).select(*rest, "__w", F.posexplode("spans").alias("line", "s"))
    size = F.col("s.end") - F.col("s.start")
    target = F.array_join(F.slice("__w", F.col("s.start") + 1, size), " ")
    return each.where((size > 0) & (F.col("s.distance") <= most * size)).select(*rest, "line", target.alias("target"), F.col("s.distance").alias("distance"))


#: Words of a sentence, at least and at most, and signs that three in ten end with.
LEAST, MOST, SIGNS = 3, 12, ".,!?:"


def counter(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2**60 - 1 that depends on ``seed`` and ``parts`` alone: the first digits of their md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sentences(words: DataFrame, n: int, seed: int = 42, word: str = "word") -> DataFrame:
    """id and text of up to n different sentences of LEAST to MOST words of ``words``; a sentence made again is left out.

    Each choice is a hash of the seed, the sentence's number and the place in it, over the words in their order, so the sentences are the same
    for any partitioning. Words of fewer than two characters, and nulls, aren't used; without words there are no sentences.
    """
    spark = words.sparkSession
    table = ranked(words.select(F.trim(F.col(word)).alias("w")).where("length(w) >= 2").distinct(), ["w"], "place")
    have = table.count()
    if not have:
        return spark.createDataFrame([], "id long, text string")
    length = LEAST + counter(seed, F.lit("length"), F.col("id")) % (MOST - LEAST + 1)
    slots = spark.range(n).select("id", F.posexplode(F.sequence(F.lit(1), length.cast("int"))).alias("k", "__k")).drop("__k")
    chosen = slots.withColumn("place", counter(seed, F.lit("word"), F.col("id"), F.col("k")) % have + 1).join(table, "place")
    made = chosen.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), " ").alias("text"))
    sign = F.when(
        counter(seed, F.lit("end"), F.col("id")) % 10 < 3, F.substring(F.lit(SIGNS), (counter(seed, F.lit("sign"), F.col("id")) % len(SIGNS) + 1).cast("int"), F.lit(1))
    ).otherwise("")
    ended = made.select("id", F.concat("text", sign).alias("text"))
    return ended.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
