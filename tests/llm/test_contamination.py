import random
import re

import pytest

from quirelake.llm import wumanber

from .conftest import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, window=13):
    wins = {}
    for item, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (who := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= who
        out.append((str(d), len(w), len(hit), sorted(str(x) for x in found if x is not None), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([3, 12, 13, 14, 40]))) for i in range(12)]
    return items + [(20, None), (21, ""), (22, "!!"), (23, items[4][1]), (None, "an item without id " * 4), (24, "a b a b a b a b a b a b a b a b")]


@pytest.fixture(scope="module")
def texts(bench, fixture_rows):
    rng = random.Random(12)
    out = [(r[0], r[1]) for r in fixture_rows]
    for i in range(60):
        item = bench[rng.randrange(len(bench))][1] or ""
        w = item.split()
        cut = rng.randint(0, max(0, len(w) - 13))
        out.append((1000 + i, prose(rng, rng.randint(0, 40)) + " " + " ".join(w[cut:]).upper() + "; " + prose(rng, rng.randint(0, 200))))
    return out + [(2000, "a b " * 3000)]


@pytest.mark.parametrize("most_bytes", [32_000_000, 400])
def test_against_brute_force(spark, texts, bench, most_bytes):
    docs, items = spark.createDataFrame(texts, "doc_id long, text string").repartition(2), spark.createDataFrame(bench, "item_id long, text string")
    got = [
        (
            str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]
        ) for r in wumanber.contamination(docs, items, most_bytes=most_bytes).collect()
    ]
    assert sorted(got, key=str) == brute(texts, bench)


@pytest.mark.parametrize("most_bytes", [32_000_000, 400])
def test_contaminated_rows_go(spark, clashing, fixture_rows, bench, most_bytes):
    items = spark.createDataFrame(bench, "item_id long, text string")
    out = wumanber.drop_contaminated(clashing, items, most_bytes=most_bytes)
    want = sorted(x[0] for x in brute([(r[0], r[1]) for r in fixture_rows], bench) if not x[4])
    assert out.columns == clashing.columns and sorted(str(r["doc_id"]) for r in out.collect()) == want


def test_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert wumanber.contamination(docs, none).where("n_hit > 0").count() == 0
    assert wumanber.contamination(no_docs, none).count() == 0
