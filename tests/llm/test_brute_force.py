"""Results that have no SQL, against versions written the long way."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from quirelake.llm import compression, jaccard, private, pu_quality, site_lines, wumanber
from quirelake.llm import recurrent as R

from .conftest import prose
from .test_jaccard import grams

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_compression_figures(docs, fixture_rows):
    z, limits = zstandard.ZstdCompressor(level=3), compression.Limits()
    size = lambda b: len(z.compress(b))

    def outside(b):
        low, high = next(((lo, hi) for least, lo, hi in reversed(limits.bands) if len(b) >= least), (0.0, math.inf))
        return not low <= size(b) / len(b) <= high

    want = []
    for d, t, *_ in fixture_rows:
        b = (t or "").encode()
        parts = [b[i : i + 1024] for i in range(0, len(b), 1024)]
        bad = sum(map(outside, parts)) if len(parts) > 1 else 0
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(8)}
        kept = len(w) >= 20 and 100 * len(hit) <= 30 * len(w) and not outside(b) and not (len(parts) > 1 and 2 * bad >= len(parts))
        want.append((str(d), size(b) / len(b) if b else 1.0, len(parts), bad, kept))
    got = [(str(r["doc_id"]), r["doc_ratio"], r["n_chunks"], r["n_bad_chunks"], r["kept"]) for r in compression.quality_rules(docs).collect()]
    assert sorted(got) == sorted(want)


def test_last_chunk_is_tested():
    z, rng = zstandard.ZstdCompressor(level=3), random.Random(3)
    clean = prose(rng, 400).encode()[:1024]
    assert compression.measure(clean + b"ab " * 300, compression.Limits(), z)[9] == 1
    assert compression.measure(clean + prose(rng, 60).encode(), compression.Limits(), z)[9] == 0


def test_quality_scores_from_plain_sums(spark, docs, fixture_rows):
    good = {i for i in range(0, 60, 3)}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    x = pu_quality.indicators(np.array([pu_quality.statistics((t or "").encode()) for _, t, *_ in fixture_rows])).astype(float)
    held = np.array([d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d, *_ in fixture_rows])
    trusted = np.array([d in good for d, *_ in fixture_rows]) & ~held
    stats = {"all": (len(x), x.mean(0), x.T @ x / len(x)), "trusted": (trusted.sum(), x[trusted].mean(0), x[trusted].T @ x[trusted] / trusted.sum())}
    start = np.linalg.solve(stats["all"][2] + stats["trusted"][2] + 1e-3 * np.eye(x.shape[1]), stats["trusted"][1] - stats["all"][1])
    place = np.clip(((x @ start / np.abs(start).sum() + 1) / 2 * 512).astype(int), 0, 511)
    prior = pu_quality.class_prior(np.bincount(place[trusted], minlength=512), np.bincount(place, minlength=512))
    w = pu_quality.fit(stats, prior)
    want = sorted((str(d), bool(h), round(1 / (1 + math.exp(-2 * f)), 6)) for (d, *_), h, f in zip(fixture_rows, held, x @ w, strict=True))
    got = sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 6)) for r in pu_quality.quality_scores(docs, labels).collect())
    assert [g[:2] for g in got] == [g[:2] for g in want] and np.allclose([g[2] for g in got], [g[2] for g in want], atol=2e-6)


SMALL = R.Settings(units=4, single=3, grouped=4, members=9, frequent=10_000, streams=4, start_rate=0.0, rate=0.0)


def slow_score(text, counts, v, p, n_train, s):
    """log10 probability of a text, token by token, with every factor in full."""
    sig = lambda a: 1 / (1 + np.exp(-a))
    h, given, total = np.zeros(s.units), v.end, 0.0
    rest = Counter()
    for w, n in counts.items():
        if w.encode() not in v.symbols:
            rest[zlib.crc32(w.encode()[-2:]) % s.grouped] += n + 0.5
    for w in [*re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW)), None]:
        x = p["x"][given].astype(float)
        g = sig(x[: 2 * s.units] + h @ p["u"])
        z, r = g[: s.units], g[s.units :]
        new = np.tanh(x[2 * s.units :] + r * (h @ p["n"]))
        h = (1 - z) * new + z * h
        out = np.exp(h @ p["o"] + p["b"])
        symbol = v.end if w is None else v.symbols.get(w.encode(), int(v.rest[zlib.crc32(w.encode()[-2:]) % s.grouped]))
        k = int(v.classes[symbol])
        chance = out[k] / out.sum()
        if s.single <= k < s.end:
            rows = slice(*v.first[k - s.single : k - s.single + 2])
            inner = np.exp(p["w"][rows] @ h + p["wb"][rows])
            chance *= inner[symbol - s.single - rows.start] / inner.sum()
            if symbol == v.rest[k - s.single]:
                chance *= (counts[w] + 0.5) / (rest[k - s.single] + 0.5)
        total += math.log10(chance)
        given = symbol
    return total


def test_recurrent_scores_token_by_token(docs, fixture_rows):
    train = [t or "" for d, t, *_ in fixture_rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)))
    v = R.Vocabulary(sorted(((w.encode(), n) for w, n in counts.items()), key=lambda x: (-x[1], x[0])), SMALL)
    share = np.zeros(len(v.classes))
    for w, n in counts.items():
        symbol = v.symbols.get(w.encode(), int(v.rest[zlib.crc32(w.encode()[-2:]) % SMALL.grouped]))
        share[symbol] += n + 0.5 * (w.encode() not in v.symbols)
    share[v.end] = len(train)
    p = R.initial(SMALL, v)
    classes = np.bincount(v.classes, share + 0.5, SMALL.classes)
    p["b"], p["wb"], p["w"] = np.log(classes / classes.sum()), np.log((share + 0.5) / classes[v.classes])[SMALL.single : v.end], p["w"] * 0.1
    want = sorted((str(d), slow_score(t or "", counts, v, p, len(train), SMALL)) for d, t, *_ in fixture_rows if len(t or "") < 5000)
    long = {str(d) for d, t, *_ in fixture_rows if len(t or "") >= 5000}
    got = sorted((str(r["doc_id"]), r["score"]) for r in R.score_documents(docs, settings=SMALL).collect() if str(r["doc_id"]) not in long)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=2e-4, atol=1e-3)


def test_words_in_classes_by_differences():
    s = R.Settings(units=3, single=2, grouped=2, members=6, streams=2, window=5)
    v = R.Vocabulary([(w.encode(), 20 - i) for i, w in enumerate("the of und für aa ab ac ad".split())], s)
    given, want = np.random.default_rng(1).integers(0, v.end, (2, 5, 2))

    def loss(p):
        h, total = np.zeros((2, 3)), 0.0
        for t in range(5):
            h = R._step(p, p["x"][given[t]], h)[0]
            y = h @ p["o"] + p["b"]
            for k in range(2):
                c = int(v.classes[want[t, k]])
                total -= y[k, c] - np.log(np.exp(y[k]).sum())
                if c >= s.single:
                    rows = slice(*v.first[c - s.single : c - s.single + 2])
                    inner = p["w"][rows] @ h[k] + p["wb"][rows]
                    total -= inner[want[t, k] - s.single - rows.start] - np.log(np.exp(inner).sum())
        return total / 10

    p = {k: x.astype(np.float64) for k, x in R.initial(s, v).items()}
    t = R.Trainer({k: x.copy() for k, x in p.items()}, s, 0.0, v)
    t._window(given, want, np.zeros((2, 3)))
    for k in p:
        grad = t.m[k] / 0.1
        for at in list(np.ndindex(p[k].shape))[::2]:
            up, down = {n: x.copy() for n, x in p.items()}, {n: x.copy() for n, x in p.items()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6), (k, at)


def test_recall_by_similarity(spark):
    """Near copies of every similarity from the threshold on are found, and none below it."""
    rng, rows, pairs = random.Random(4), [], []
    for i in range(400):
        w = prose(rng, rng.choice([30, 80, 200])).split()
        v = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 40))):
            v[rng.randrange(len(v))] = f"neu{rng.random()}"
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    sets = {d: grams(t) for d, t in rows}
    alike = {a: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    got = {r["doc_id"]: r["group_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {a: got[a] == got[b] for a, b in pairs}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        own = [a for a in alike if low <= alike[a] < high]
        assert len(own) > 20 and sum(found[a] for a in own) >= 0.99 * len(own)
    assert not any(found[a] for a in alike if alike[a] < 0.8)


def test_a_callers_counts_stay(clashing):
    out = site_lines.drop_site_lines(clashing)
    assert out.columns == [*clashing.columns, "site_n_lines", "site_n_dropped"] and {r["n_lines"] for r in out.collect()} == {"z"}


def test_many_matches_in_one_text(spark):
    n = 3000
    got = private.find_private(spark.createDataFrame([(1, "a@b.co éé " * n), (2, "1.2.3.4")], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [(s["s"], s["e"]) for s in r["spans"] if s["kind"] == "email"] for r in got}
    assert spans == {1: [(10 * i, 10 * i + 6) for i in range(n)], 2: []}


def test_shift_table_grows_with_the_patterns():
    rng = random.Random(6)
    words = [f"{x}{y}" for x in range(200) for y in "abcdefgh"]
    b = wumanber.Benchmark([(str(i), " ".join(rng.choices(words, k=200))) for i in range(300)])
    (search,) = b.parts
    assert search.shift.mean() > 10 and len(search.at) > 50_000
