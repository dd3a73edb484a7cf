import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quirelake.llm.ranking import best_of_block, item_rows, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10, once=True):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    documents, total = sum(n > 0 for n in sizes), sum(sizes)
    having = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        wanted, scored = Counter(terms(text)), []
        for (i, c), n in zip(counts, sizes, strict=True):
            score = 0
            for t, times in wanted.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * having[t] + 1)))
                    m = 10 + 90 * n * documents // total
                    score += (1 if once else times) * w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scored.append((-score, i is not None, i or 0))
        out += [(item, k + 1, i if has else None, -s) for k, (s, has, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def made(seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Straße", "Ünï", "THE", "the", "x-y", "1", "世界"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(150)]
    docs += [(200 + i, "the w1 w2 same text") for i in range(40)]  # ties
    docs += [(300, None), (301, ""), (302, " ., "), (None, "w1 w3 w3"), (5, "w1 w1 w2"), (5, "w1 w1 w2"), (303, "w4 " * 50_000)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12])))) for k in range(20)] + [("none", None), ("odd", "... zzz"), ("same", "the w1 w2 same text w2")]
    return docs, items


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("most_bytes", [16_000_000, 300])
def test_against_brute_force(spark, once, most_bytes):
    docs, items = made()
    got = search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string"), once=once, most_bytes=most_bytes
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, once=once)


def test_empty_tables_and_clashing_columns(spark, docs, no_docs, clashing):
    items = spark.createDataFrame([(1, "the of and line site")], "item_id long, text string")
    assert search(no_docs, items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert sorted(map(str, search(clashing, items.selectExpr("*", "1 AS key", "2 AS item", "3 AS part")).collect())) == sorted(map(str, search(docs, items).collect()))


def test_scores_beyond_doubles_stay_whole():
    items = item_rows([(7, "a b")])
    big = np.array([2**60, 1, 2**60], np.int64)  # entries by term: a in documents 0 and 1, b in document 0
    who, where, score = best_of_block(items, np.array([0, 1, 0]), np.array([0, 0, 1]), big, 2, 10)
    assert (who.tolist(), where.tolist(), score.tolist()) == ([0, 0], [0, 1], [2**61, 1])
