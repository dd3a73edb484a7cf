import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import jaccard
from quirelake.llm.components import components

from .conftest import prose


def grams(t):
    w = [x.lower() if x.isascii() else x for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, at=0.8):
    sets = [(d, grams(t)) for d, t in rows]
    least = {}
    for d, s in sets:
        least[s] = min([x for x in (least.get(s), d) if x is not None], default=None)
    classes, links = list(least), defaultdict(set)
    for i, a in enumerate(classes):
        for b in classes[:i]:
            if a and b and len(a & b) / len(a | b) >= at:
                links[a].add(b)
                links[b].add(a)
    group = {}
    for c in classes:
        if c not in group:
            todo, seen = [c], {c}
            while todo:
                for o in links[todo.pop()] - seen:
                    seen.add(o)
                    todo.append(o)
            ids = [least[x] for x in seen if least[x] is not None]
            group |= dict.fromkeys(seen, min(ids, default=None))
    return sorted(((d, least[s], len(links[s]), group[s]) for d, s in sets), key=str)


def near_rows():
    rng, out = random.Random(2), []
    for f in range(8):
        w = prose(rng, 80).split()
        for k in range(rng.choice([2, 3, 30])):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "neu"
            out.append((len(out), " ".join(v)))
    return out


@pytest.mark.parametrize(
    "settings",
    [jaccard.JoinSettings(), jaccard.JoinSettings(block=4), jaccard.JoinSettings(block=4, largest=3), jaccard.JoinSettings(filter_bits=64)]
)
def test_against_brute_force(spark, fixture_rows, settings):
    rows = [(10_000 + d, t) for d, t in near_rows()] + [(r[0], r[1]) for r in fixture_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(
        ((r["doc_id"], r["class_id"], r["n_links"], r["group_id"]) for r in jaccard.near_duplicates(docs, settings=settings).collect()), key=str
    )
    assert got == brute(rows)


def test_one_of_each_group_stays(spark, clashing, no_docs, docs):
    out = jaccard.keep_one_of_each(clashing)
    found = jaccard.near_duplicates(docs).where("doc_id IS NOT NULL")
    assert out.columns == clashing.columns
    assert sorted(
        r[0] for r in out.where("doc_id IS NOT NULL").select("doc_id").collect()
    ) == sorted(r[0] for r in found.select("group_id").distinct().collect())
    assert jaccard.keep_one_of_each(no_docs).count() == 0 and jaccard.near_duplicates(no_docs).count() == 0


def test_pruning_bounds():
    least = jaccard.least_matches(0.8, 1e-6, 120)
    assert (np.diff(least) >= 0).all() and 60 < least[120] < 96


def test_common_sizes():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    assert jaccard._common(sets, i, j, 7).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_minhash_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    sig = jaccard.minhash([np.unique(a), np.unique(b)], 400)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (3, 1)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | dict.fromkeys(range(6, 12), 6)
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_one_of_each_group_stays_whatever_the_ids(spark):
    rng = random.Random(8)
    base, *other = (prose(rng, 60) for _ in range(9))
    close = base + " ende"
    rows = [(None, base), (None, close), (None, other[0]), (None, other[0]), (None, other[1]), (7, other[2]), (7, other[3]), (7, other[3] + " .")]  # null and shared ids with unlike texts
    rows += [(1, other[4]), (2, other[4] + " ende"), (2, other[5]), (3, other[6]), (3, other[6]), (None, None), (9, ""), (4, other[7])]  # the near copy with id 2 goes, the other text of it stays
    got = jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r["text"] in (base, close) for r in got) == 1 and sum((r["text"] or "").removesuffix(" .") == other[3] for r in got) == 1
    left = [(r["doc_id"], r["text"]) for r in got if r["text"] not in (base, close) and (r["text"] or "").removesuffix(" .") != other[3]]
    want = [(None, other[0]), (None, other[1]), (7, other[2]), (1, other[4]), (2, other[5]), (3, other[6]), (9, ""), (4, other[7])]
    assert sorted(left, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bits", [64, 1 << 25])
def test_unlike_texts_without_ids_all_stay(spark, bits):
    rng = random.Random(9)
    rows = [(None, prose(rng, 40)) for _ in range(50)] + [(5, prose(rng, 40)) for _ in range(50)]
    assert sorted(
        map(
            tuple,
            jaccard.keep_one_of_each(
                spark.createDataFrame(rows, "doc_id long, text string"), settings=jaccard.JoinSettings(filter_bits=bits)
            ).collect()
        ),
        key=str
    ) == sorted(rows, key=str)


def test_texts_of_signs_alone_stay_apart(spark):
    rows = [(1, "!!! ???"), (2, "*** ---"), (3, "!!! ???"), (4, "!!!  ???\n"), (5, None), (6, ""), (7, " \n"), (8, "... " * 40_000), (9, "wörter gibt es hier"), (None, "*** ---"), (10, "~")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in jaccard.keep_one_of_each(docs).collect()) == [1, 2, 5, 8, 9, 10]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert got == {1: (1, 0), 2: (2, 0), 3: (1, 0), 4: (1, 0), 5: (5, 0), 6: (5, 0), 7: (5, 0), 8: (8, 0), 9: (9, 0), 10: (10, 0)}
