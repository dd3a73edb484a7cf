"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word 5-gram hashes are one class. MinHash values, banded, give candidate classes; those that share a band form
components, within which pairs meet in blocks of bounded size. A block compares its pairs' MinHash values a few at a time and drops a pair
once the posterior probability that its similarity reaches the threshold, given the matches so far and a uniform prior, is below a
tolerance. The rest, if they share a band, are verified on the whole sets. No pair leaves its block: each class gets its number of links and
a link to the least class it is joined to there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, discard
from .words import WordHash, alnum_words, portions, row_texts


@dataclass(frozen=True)
class JoinSettings:
    """At 24 bands of 5 values, a pair of similarity 0.8 shares none with probability 7e-5, one of 0.85 with 8e-7.

    tolerance: posterior probability under which a pair is dropped. step: MinHash values compared at a time. block: classes in a block. most_pairs: pairs compared at a time.
    largest: classes in a component from which on blocks are of one band's classes, each pair in the first band it shares, not of the
    component's. That changes which rows meet where, not what is linked: it is the pairs that share a band and reach the threshold.
    filter_bits: size of the filter that lets candidate rows through on the second reading; it only saves work.
    """

    threshold: float = 0.8
    words: int = 5
    bands: int = 24
    rows: int = 5
    tolerance: float = 1e-6
    step: int = 8
    block: int = 512
    most_pairs: int = 1 << 17
    largest: int = 16_384
    filter_bits: int = 1 << 25

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``width`` word hashes; of the whole text if it has fewer words."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        h = (h + words[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n).astype(np.uint32)


def minhash(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n MinHash values of each non-empty set."""
    a, b = _permutations(n)
    out = np.zeros((len(sets), n), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (size < 60_000 or to == at):
            size += len(sets[to])
            to += 1
        x = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        for k in range(n):
            out[at:to, k] = np.minimum.reduceat(x * a[k] + b[k], first)
        at = to
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, its number mixed in."""
    keys = np.zeros((len(sig), bands), np.uint64)
    for j in range(bands):
        h = np.full(len(sig), j + 1, np.uint64)
        for k in range(j * rows, (j + 1) * rows):
            h = (h + sig[:, k]) * _MIX
            h ^= h >> np.uint64(31)
        keys[:, j] = h
    return keys


@cache
def least_matches(threshold: float, tolerance: float, hashes: int) -> np.ndarray:
    """For each number of MinHash values compared: the fewest matches that keep a pair.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), whose tail above t is a binomial sum.
    """
    out = np.zeros(hashes + 1, np.int64)
    for n in range(1, hashes + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _sets(column: pa.Array, width: int, hashes: WordHash) -> list[np.ndarray]:
    return [shingles(hashes.of(alnum_words(t)), width) for t in row_texts(column)]


def _class_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _wordless_key(text: str | None) -> bytes:
    """A text without words is in the class of its signs: unlike ones aren't near duplicates. White space alone, empty and null are one class."""
    return xxhash.xxh3_128_digest("".join((text or "").split()).encode(), seed=1)


def _tag(key: bytes, doc) -> int:
    return xxhash.xxh3_64_intdigest(key + repr(doc).encode()) >> 1


def _fingerprints(docs: DataFrame, s: JoinSettings, kind: str) -> DataFrame:
    """id, class key, tag of class and id, and band keys of each row (none for a text without words), and further columns of binary as they are."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in portions(batches, 1):
            sets = _sets(b.column(1), s.words, hashes)
            some = [i for i, x in enumerate(sets) if len(x)]
            keys: list = [[]] * len(sets)
            if some:
                for i, row in zip(some, band_keys(minhash([sets[i] for i in some], s.hashes), s.bands, s.rows).view(np.int64).tolist(), strict=True):
                    keys[i] = row
            classes = [_class_key(x) if len(x) else _wordless_key(b.column(1)[i].as_py()) for i, x in enumerate(sets)]
            tags = [_tag(c, d) for c, d in zip(classes, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(classes, pa.binary()), pa.array(tags, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *b.columns[2:]],
                names=["id", "class", "tag", "bands", *more]
            )

    return docs.mapInArrow(run, ", ".join([f"id {kind}, class binary, tag long, bands array<long>", *(f"{c} binary" for c in more)]))


def _payload(docs: DataFrame, s: JoinSettings, bits: np.ndarray) -> DataFrame:
    """MinHash values, band keys and sets of the rows whose tag the filter lets through."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words = WordHash(), held.value
        for b in portions(batches, 1):
            rows = []
            for doc, x in zip(b.column(0).to_pylist(), _sets(b.column(1), s.words, hashes), strict=True):
                if len(x):
                    key = _class_key(x)
                    at = _tag(key, doc) % s.filter_bits
                    if words[at >> 6] >> np.uint64(at & 63) & np.uint64(1):
                        rows.append((key, x))
            if rows:
                sig = minhash([x for _, x in rows], s.hashes)
                keys = band_keys(sig, s.bands, s.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary()) for c in ([k for k, _ in rows], [x.tobytes() for x in sig], [x.tobytes() for x in keys], [x.tobytes() for _, x in rows])],
                    names=["class", "sig", "keys", "grams"]
                )

    return docs.mapInArrow(run, "class binary, sig binary, keys binary, grams binary").groupBy("class").agg(
        F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.first("grams").alias("grams")
    )


def _filter(tags: DataFrame, n_bits: int) -> np.ndarray:
    """Bits of the tags' places: of a fixed size, whatever their number."""
    at = F.pmod("tag", F.lit(n_bits))
    got = tags.select(at.alias("at")).selectExpr(
        "shiftright(at, 6) AS word", "shiftleft(1L, int(at % 64)) AS bit"
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.int64)
    out[np.asarray(got["word"])] = np.asarray(got["bits"])
    return out.view(np.uint64)


def _not_pruned(sig: np.ndarray, left: np.ndarray, right: np.ndarray, s: JoinSettings) -> np.ndarray:
    """Numbers of the pairs whose MinHash values keep them, compared a few at a time."""
    alive, matches, least = np.arange(len(left)), np.zeros(len(left), np.int64), least_matches(s.threshold, s.tolerance, s.hashes)
    for at in range(0, s.hashes, s.step):
        to = min(at + s.step, s.hashes)
        matches = matches + (sig[left[alive], at:to] == sig[right[alive], at:to]).sum(1)
        stay = matches >= least[to]
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def linked_pairs(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, s: JoinSettings) -> np.ndarray:
    """Which of the pairs (left[k], right[k]) reach the threshold: numbers k."""
    alive = np.concatenate(
        [
            np.zeros(0, np.int64),
            *(at + _not_pruned(sig, left[at : at + s.most_pairs], right[at : at + s.most_pairs], s) for at in range(0, len(left), s.most_pairs))
        ]
    )
    if not len(alive):
        return alive
    size = np.array([len(x) for x in sets])
    i, j = left[alive], right[alive]
    most = np.minimum(size[i], size[j])
    fits = most >= s.threshold * np.maximum(size[i], size[j]) - 1e-9
    alive, i, j = alive[fits], i[fits], j[fits]
    if len(alive) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        common = _common(sets, i, j)
    return alive[common >= s.threshold * (size[i] + size[j] - common) - 1e-9]


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of intersections of many pairs, by products of membership matrices over the elements that several sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    owner, column = owner[several], column[several]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.concatenate([[0], np.diff(column[order]) > 0])) if len(order) else column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def _block(members: list[tuple[bytes, int, bytes, bytes, bytes]], band: int | None, s: JoinSettings) -> list[tuple[bytes, int, bytes]]:
    """Links among (class, side, sig, keys, set): within side 0 if there is no other, else between the sides."""
    n = len(members)
    side = np.array([m[1] for m in members])
    if (side == 1).any():
        zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        left, right = np.repeat(zero, len(one)), np.tile(one, len(zero))
    else:
        left, right = np.triu_indices(n, 1)
    if not len(left):
        return []
    sig, sets = np.array([np.frombuffer(m[2], np.uint32) for m in members]), [np.frombuffer(m[4], np.uint64) for m in members]
    k = linked_pairs(sig, sets, left, right, s)
    left, right = left[k], right[k]
    keys = np.array([np.frombuffer(m[3], np.uint64) for m in members])
    own = [np.zeros(0, bool)]
    for at in range(0, len(left), s.most_pairs):
        i, j = left[at : at + s.most_pairs], right[at : at + s.most_pairs]
        same = keys[i] == keys[j]
        share = same.any(1)
        own.append(share if band is None else share & (keys[i, same.argmax(1)] == np.int64(band).view(np.uint64)))
    own = np.concatenate(own)
    left, right = left[own], right[own]
    if not len(left):
        return []
    links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    order = sorted(range(n), key=lambda x: members[x][0])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    root = rank.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, left, root[right])
        np.minimum.at(root, right, root[left])
        if (root == before).all():
            break
    return [(members[x][0], int(links[x]), members[order[root[x]]][0]) for x in range(n) if links[x]]


def _evaluate(units: DataFrame, s: JoinSettings) -> DataFrame:
    """Rows of a unit arrive together, sorted; each unit's links are found when its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done() -> list:
            return _block(held, unit[3], s) if len(held) > 1 else []

        def told(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.binary())
                ],
                names=["class", "links", "root"]
            )

        for b in batches:
            out = []
            for comp, i, j, band, side, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if unit != (comp, i, j, band):
                    out += done() if unit else []
                    unit, held = (comp, i, j, band), []
                held.append((row[0], side, *row[1:]))
            if out:
                yield told(out)
        if unit and (out := done()):
            yield told(out)

    by = ["comp", "i", "j", "band"]
    return units.repartition(*by).sortWithinPartitions(*by).select(
        *by, "side", "class", "sig", "keys", "grams"
    ).mapInArrow(run, "class binary, links long, root binary")


def _blocks(members: DataFrame, sizes: DataFrame, s: JoinSettings) -> DataFrame:
    """A row for each block pair that a member of (comp, band, class) takes part in."""
    n = F.ceil(F.col("n") / s.block).cast("int")
    m = members.join(sizes, ["comp", "band"]).select(
        "comp", "band", "class", n.alias("blocks"), F.pmod(F.xxhash64("class"), n).cast("int").alias("k")
    )
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select(
        "comp", "band", "class", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"),
        (F.col("k") > F.col("other")).cast("int").alias("side")
    )


def _star(pairs: DataFrame) -> DataFrame:
    """Edges (a, b) that join what ``pairs`` (node, hub) join: each node with the least of its hubs, and that hub with the node's others.

    There are about as many as nodes, however many hubs each has, as long as few hubs serve many nodes.
    """
    least = pairs.select("node", "hub", F.min("hub").over(Window.partitionBy("node")).alias("least"))
    edges = least.select(F.col("node").alias("a"), F.col("least").alias("b")).union(least.select(F.col("least"), F.col("hub")))
    return edges.where("a != b").distinct()


def _linked(plain: DataFrame, s: JoinSettings, *least: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, text, further columns): the rows with their classes; the classes with the aggregates ``least``; those with links, their number and component."""
    kind = plain.schema["id"].dataType.simpleString()
    rows = cut(_fingerprints(plain, s, kind), "fingerprints")
    classes = cut(rows.groupBy("class").agg(F.min("tag").alias("tag"), F.first("bands").alias("bands"), *least), "classes")
    keyed = classes.select("class", F.explode("bands").alias("band"))
    shared = cut(keyed.groupBy("band").agg(F.min("class").alias("hub"), F.count("*").alias("n")).where("n > 1"), "shared-bands")
    hubs = keyed.join(shared, "band").select(F.col("class").alias("node"), "hub").distinct()
    comps = cut(components(_star(hubs)).withColumnRenamed("node", "class"), "candidates")
    sizes = cut(comps.groupBy("comp").agg(F.count("*").alias("n")), "candidate-sizes")
    no_band = F.lit(None).cast("long").alias("band")
    units = _blocks(
        comps.select("comp", F.lit(0).cast("long").alias("band"), "class"),
        sizes.where(F.col("n") <= s.largest).select("comp", F.lit(0).cast("long").alias("band"), "n"), s
    ).drop("band").select("*", no_band)
    if sizes.where(F.col("n") > s.largest).limit(1).count():
        large = comps.join(sizes.where(F.col("n") > s.largest), "comp").select("class")
        members = keyed.join(large, "class").join(shared.select("band"), "band").select(F.lit(b"").alias("comp"), "band", "class")
        units = units.unionByName(_blocks(members, shared.select(F.lit(b"").alias("comp"), "band", "n"), s))
    tags = classes.join(comps.select("class"), "class", "left_semi").select("tag")
    payload = _payload(plain.select("id", "text"), s, _filter(tags, s.filter_bits))
    found = cut(_evaluate(units.join(payload, "class"), s), "links")
    for used in (shared, comps, sizes):
        discard(used)
    links = found.groupBy("class").agg(F.sum("links").alias("n_links"))
    group = components(_star(found.select(F.col("class").alias("node"), F.col("root").alias("hub")).distinct())).withColumnRenamed("node", "class")
    linked = cut(classes.drop("tag", "bands").join(links, "class").join(group, "class"), "linked")
    discard(found)
    return rows, classes, linked


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings = JoinSettings()) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links and group_id.

    class_id: the least id with the same set of word n-grams (lower-cased words of letters and digits; a text of fewer words than n is one
    gram). n_links: how many other classes reach the threshold with this one. group_id: the least id of all classes linked with it,
    directly or through others. Texts without words have no links; their class is that of their signs, white space aside, so that empty and null texts are one. Ids may be null (ignored among
    least ids unless all are null) or repeat; an empty table gives an empty result; other columns are not read.
    """
    rows, classes, linked = _linked(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), settings, F.min("id").alias("rep"))
    least = linked.groupBy("comp").agg(F.min("rep").alias("group_id"))
    known = linked.join(least, "comp").select("class", "n_links", "group_id")
    table = cut(
        classes.select("class", F.col("rep").alias("class_id")).join(known, "class", "left").select(
            "class", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id")
        ),
        "class-table"
    )
    return rows.select("id", "class").join(table, "class").select(F.col("id").alias(id_col), "class_id", "n_links", "group_id")


def _in_filter(docs: DataFrame, bits: np.ndarray, n_bits: int, tag: str) -> Column:
    """Whether a row's place in the filter is set. Only the column ``tag`` goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def is_set(column: pa.Array) -> pa.Array:
        at = np.mod(np.asarray(column), n_bits)
        return pa.array(held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1)

    return is_set(F.col(tag))


def _row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text; nulls are values of their own."""
    own = [F.when(F.col(c).isNull(), "").otherwise(F.md5(F.col(c).cast("string"))) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat_ws(",", *own)))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: JoinSettings = JoinSettings()) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates: one of the least id stays (null only if all are), of those one text's.

    Rows are told apart by id and text together, so ids may be null or repeat: rows of other groups stay whatever their id. Rows that repeat
    both are one. Texts without words are near duplicates of those with the same signs only, white space aside; null and empty ones are one. A very long text is read whole,
    and its shingles are held by one task at a time. A filter of fixed size over the rows to drop lets most pass as they are; only those that
    it may hold are joined with them, so few texts are shuffled.
    """
    s, key = settings, _row_key(id_col, text_col)
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), key.alias("key"))
    rows, classes, linked = _linked(plain, s, F.min(F.struct(F.isnull("id").alias("none"), "id", "key")).alias("first"))
    stay = linked.groupBy("comp").agg(F.min("first").alias("first")).select("first.key").union(
        classes.join(linked.select("class"), "class", "left_anti").select("first.key")
    )
    told = rows.select("key", F.lit(1).alias("n"), F.lit(0).alias("stays")).union(stay.select("key", F.lit(0), F.lit(1)))
    found = cut(
        told.groupBy(F.col("key").alias("__key")).agg(F.sum("n").alias("n"), F.max("stays").alias("stays")).where("stays = 0 OR n > 1"), "decisions"
    )
    drop = found.where("stays = 0").select("__key")
    keyed = docs.withColumn("__key", key).withColumn("__h", F.xxhash64("__key"))
    bits = _filter(found.select(F.xxhash64("__key").alias("tag")), s.filter_bits)
    hit = _in_filter(docs, bits, s.filter_bits, "__h")
    maybe = keyed.where(hit)
    if found.where("n > 1").limit(1).count():
        maybe = maybe.dropDuplicates(["__key"])
    return keyed.where(~hit).select(*docs.columns).union(maybe.join(drop, "__key", "left_anti").select(*docs.columns))
