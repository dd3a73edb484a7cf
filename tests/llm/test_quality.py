import random
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from quirelake.llm import compression, pu_quality
from quirelake.llm.words import Numbering, windows_repeated

from .conftest import prose


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_base_figures_against_brute_force(docs, fixture_rows):
    got = [
        (
            str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]
        ) for r in compression.quality_rules(docs).collect()
    ]
    assert sorted(got) == sorted((str(d), *brute(t or "")) for d, t, *_ in fixture_rows)


def test_windows():
    for n in range(0, 40):
        w = [b"abcdefgh"[i : i + 1] for i in np.random.default_rng(n).integers(0, 2, n)]
        c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        assert windows_repeated(Numbering().of(w), 3) == len({i + k for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_bands():
    rng, z = random.Random(1), zstandard.ZstdCompressor(level=3)
    clean = prose(rng, 600).encode()
    assert compression.measure(clean, compression.Limits(), z)[-1] == ""
    assert compression.measure(
        " ".join("".join(rng.choices("0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz+/%$#@!&*", k=60)) for _ in range(80)).encode(),
        compression.Limits(), z
    )[-1] == "incompressible"
    # no 8-word window repeats, yet it is the same few letters again and again
    dull = " ".join("a" * (i % 90 + 1) for i in range(900)).encode()
    assert compression.measure(dull, compression.Limits(), z)[6] is False


def test_rejected_rows_go(docs, clashing, no_docs):
    kept = {r["doc_id"] for r in compression.quality_rules(docs).where("kept").collect()}
    out = compression.keep_quality(clashing)
    assert out.columns == clashing.columns and {r["doc_id"] for r in out.collect()} == kept
    assert compression.quality_rules(no_docs).count() == 0 and compression.keep_quality(no_docs).count() == 0


def corpus(spark, n=900):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        t = prose(rng, rng.randint(15, 120))
        if i % 6 == 0:
            t = " ".join(f"{w}{rng.choice(['***', '&&&', '%%%'])}" for w in t.split())
        elif i % 6 == 1 and i % 4 == 1:
            t = " ".join([rng.choice(t.split())] * 60)
        rows.append((i, t, int(i % 6 != 0 and not (i % 6 == 1 and i % 4 == 1))))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(
        [(r[0], r[2], 0) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int"
    ), {r[0]: r[2] for r in rows}


def test_pu_learning_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    got = pu_quality.quality_scores(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and 200 < len(held) < 400
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_bad_labels_and_held_labels_are_not_used(spark):
    docs, labels, _ = corpus(spark, 300)
    one = {r["doc_id"]: r["score"] for r in pu_quality.quality_scores(docs, labels).collect()}
    only_good = labels.where((F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    assert one == {r["doc_id"]: r["score"] for r in pu_quality.quality_scores(docs, only_good).collect()}


def test_pu_edges(spark, docs, no_docs, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pu_quality.quality_scores(docs, none).count() == docs.count()
    assert pu_quality.quality_scores(no_docs, none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = pu_quality.quality_scores(clashing, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_prior():
    p, u = np.zeros(100), np.zeros(100)
    p[80:] = 500
    u[80:], u[:20] = 350, 150
    assert abs(pu_quality.class_prior(p, u) - 0.7) < 0.02
