import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quirelake.llm import recurrent as R

from .conftest import prose

SMALL = R.Settings(units=8, single=6, grouped=5, frequent=12, streams=8)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


@pytest.mark.parametrize("settings", [SMALL, R.Settings()])
def test_base_against_brute_force(docs, fixture_rows, settings):
    c = Counter(w for d, t, *_ in fixture_rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (
            str(d), held(d), len(w := tokens(t)), sum(c[x] > 0 for x in w), n,
            round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)
        ) for d, t, *_ in fixture_rows
    )
    got = sorted(
        (
            str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)
        ) for r in R.score_documents(docs, settings=settings).collect()
    )
    assert got == want


@pytest.mark.parametrize("ids", ["id", "CAST(NULL AS long)"])
def test_start_draws_copies_apart(spark, ids):
    copies = spark.range(3000).selectExpr(f"{ids} AS id", "'the same text' AS text")
    for text in ("the same text", ""):
        n = R.start_texts(copies.selectExpr("id", f"'{text}' AS text"), R.Settings(start_docs=300), 3000).count()
        assert 200 < n < 400


@pytest.mark.parametrize("repeats", [1000, 2])
def test_weights_do_not_depend_on_how_the_table_is_cut(docs, repeats):
    s = R.Settings(units=4, single=6, grouped=5, frequent=12, members=4, streams=4, slice_bytes=4000, start_docs=20, repeats=repeats)
    rows = docs.union(docs.limit(3).crossJoin(docs.sparkSession.range(6).select()))  # some rows seven times
    rows = rows.selectExpr("doc_id AS id", "coalesce(text, '') AS text").cache()
    v = R.Vocabulary(R._most_frequent(R.word_counts(rows.select("text")), s.frequent), s)
    one, other = (R._flat(R.train(rows.repartition(n), v, s, np.ones(len(v.classes)))) for n in (2, 13))
    assert (one == other).all() and (one != R._flat(R.initial(s, v))).any()


def test_slices_hold_every_row_once_and_deal_repeats(spark):
    rows = spark.sql("SELECT id, concat('text ', id) AS text FROM range(50) UNION ALL SELECT NULL, 'again' FROM range(400)")
    s = R.Settings(repeats=5)
    got = R.sliced(rows, R.row_counts(rows), s, 450, 4).toPandas()
    assert sorted(got["text"]) == sorted(r["text"] for r in rows.collect())
    assert got[got["text"] == "again"].groupby("slice").size().between(60, 140).all() and len(got[got["text"] == "again"]["k"].unique()) == 400


def test_portions_do_not_show_batches():
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted((rng.randrange(3), "x" * rng.randrange(30)) for _ in range(60)) + [(3, "y" * 500), (3, "z")]

    def batches(size):
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int32()), pa.array([t for _, t in part])], names=["slice", "text"])

    got = [[(n, x.to_pylist()) for n, x in R._slice_portions(batches(size), 100)] for size in (1, 7, 62)]
    assert got[0] == got[1] == got[2]
    assert [(n, t) for n, ts in got[0] for t in ts] == rows
    assert all(len(ts) == 1 or sum(map(len, ts)) <= 100 for _, ts in got[0])


def test_edges(no_docs, clashing, spark):
    assert R.score_documents(no_docs, settings=SMALL).count() == 0
    assert R.score_documents(clashing, settings=SMALL).count() == clashing.count()
    only_held = spark.createDataFrame([(next(i for i in range(100) if held(i)), "one two")], "doc_id long, text string")
    got = R.score_documents(only_held, settings=SMALL).first()
    assert (got["train_tokens"], got["n_known"], got["n_tokens"]) == (0, 0, 3) and got["base_score"] == pytest.approx(0)


def test_probabilities_sum_to_one_over_all_sequences():
    s = R.Settings(units=4, single=1, grouped=1)
    p = R.initial(s)
    total = 0.0
    for n in range(1, 9):  # all texts of up to 7 words, and the mass of longer ones
        seqs = [[(k >> i) & 1 for i in range(n - 1)] + [s.end] for k in range(2 ** (n - 1))]
        total += np.exp(R.log_class_probabilities(p, [np.array(q) for q in seqs], s)).sum()
    rest = np.exp(R.log_class_probabilities(p, [np.array([(k >> i) & 1 for i in range(8)]) for k in range(256)], s)).sum()
    assert total + rest == pytest.approx(1, abs=1e-4)


def test_state_runs_through_the_document_and_batches_do_not_matter():
    s, rng = R.Settings(), np.random.default_rng(0)
    p = R.initial(s)
    docs = [rng.integers(0, s.classes, n) for n in (1, 5, 40, 400)]
    alone = [R.log_class_probabilities(p, [d], s)[0] for d in docs]
    assert np.allclose(R.log_class_probabilities(p, docs, s), alone, rtol=1e-4)
    assert np.allclose(R.log_class_probabilities(p, docs, s, run=7), alone, rtol=1e-4)


def test_gradients_by_differences():
    s = R.Settings(units=3, single=2, grouped=2, streams=2, window=5)
    given, want = np.random.default_rng(0).integers(0, s.end, (2, 5, 2))

    def loss(p):
        h, total = np.zeros((2, 3)), 0.0
        for t in range(5):
            h = R._step(p, p["x"][given[t]], h)[0]
            y = h @ p["o"] + p["b"]
            total -= (y[np.arange(2), want[t]] - np.log(np.exp(y).sum(1))).sum()
        return total / 10

    p = {k: v.astype(np.float64) for k, v in R.initial(s).items()}
    t = R.Trainer({k: v.copy() for k, v in p.items()}, s, 0.0)
    t._window(given, want, np.zeros((2, 3)))
    for k in p:
        grad = t.m[k] / 0.1
        for at in list(np.ndindex(p[k].shape))[::3]:
            up, down = {n: v.copy() for n, v in p.items()}, {n: v.copy() for n, v in p.items()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6), (k, at)


def test_learns_more_than_counts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["the", "of"] * 20 if i % 2 else ["und", "für"] * 20) + " " + prose(rng, 20)) for i in range(300)]
    got = R.score_documents(
        spark.createDataFrame(rows, "doc_id long, text string"), settings=R.Settings(units=8)
    ).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.8 * got["sum(base_score)"]
