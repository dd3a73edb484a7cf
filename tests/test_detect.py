import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.functions import sweep
from quirelake.operators import detect, pages

SCHEMA = "image string, regions array<struct<bbox:array<double>,type:string,text:string,language:string,legibility:string,conf:double>>"


def boxes(rng, n, side=400, least=5, most=60):
    out = []
    for _ in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        out.append([float(x), float(y), float(x + rng.randrange(least, most)), float(y + rng.randrange(least, most))])
    return out


def region(rng, box, conf=None):
    kind = rng.choice(["handwritten", "printed", "formula", "image"])
    return (box, kind, rng.choice(["ein satz", "a^{2} + b", "drei", "x", ""]), "uk", "legible", conf)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if inter > 0 and union > 0 else 0.0


def brute_stays(regions, limit, by_type):
    order = sorted(range(len(regions)), key=lambda i: (-(1.0 if regions[i][5] is None else regions[i][5]), i))
    kept = []
    for i in order:
        if not any((not by_type or regions[k][1] == regions[i][1]) and iou(regions[k][0], regions[i][0]) > limit for k in kept):
            kept.append(i)
    return sorted(kept)


@pytest.fixture(scope="module")
def two_pages():
    """(image, reference, predictions) of common pages and of some that are swept; boxes touch, nest, repeat, are inverted or empty."""
    rng = random.Random(8)
    out = []
    for k, n in enumerate([0, 1, 5, 20, 40, 90, 130]):
        gt = [region(rng, b) for b in boxes(rng, n, side=300 if n < 80 else 500)]
        pred = [region(rng, [v + rng.randrange(-4, 5) for v in g[0]], rng.choice([None, 0.3, 0.5, 0.5, 0.9])) for g in gt if rng.random() < 0.9]
        pred += [region(rng, list(rng.choice(gt)[0]), 0.5) for _ in range(n // 4)]
        if n:
            pred += [region(rng, [50.0, 50.0, 20.0, 20.0], 0.7), region(rng, [10.0, 10.0, 10.0, 40.0], 0.7), region(rng, [0.0, 0.0, 500.0, 500.0], 0.4)]
        rng.shuffle(pred)
        out.append((f"p{k}", gt, pred))
    return out


def frames(spark, rows):
    return spark.createDataFrame([(i, g) for i, g, _ in rows], SCHEMA), spark.createDataFrame([(i, p) for i, _, p in rows], SCHEMA)


def brute_match(gt, pred, least):
    pairs = sorted((-iou(g[0], p[0]), i, j) for i, g in enumerate(gt) for j, p in enumerate(pred) if iou(g[0], p[0]) >= least)
    out = []
    for _, i, j in pairs:
        if all(i != a and j != b for a, b in out):
            out.append((i, j))
    return out


@pytest.mark.parametrize("least", [0.1, 0.5])
def test_matches_of_common_and_swept_pages(spark, two_pages, least):
    gt, pred = frames(spark, two_pages)
    both = gt.withColumnRenamed("regions", "g").join(pred.withColumnRenamed("regions", "p"), "image")
    got = {r["image"]: [(m["gi"], m["pi"]) for m in r["m"]] for r in both.select("image", pages.greedy_pairs(F.col("g"), F.col("p"), least).alias("m")).collect()}
    assert any(len(g) * len(p) > sweep.SMALL for _, g, p in two_pages) and any(len(g) * len(p) <= sweep.SMALL for _, g, p in two_pages)
    for image, g, p in two_pages:
        assert got[image] == brute_match(g, p, least)


def test_overlaps_of_common_and_swept_pages(spark, two_pages):
    _, pred = frames(spark, two_pages)
    got = {(r["image"], r["i"], r["j"]) for r in pages.overlap_pairs(pred, 0.3, 0.6).collect()}
    area = lambda b: max(b[2] - b[0], 0) * max(b[3] - b[1], 0)
    want = set()
    for image, _, regions in two_pages:
        for j, b in enumerate(regions):
            for i, a in enumerate(regions[:j]):
                w, h = min(a[0][2], b[0][2]) - max(a[0][0], b[0][0]), min(a[0][3], b[0][3]) - max(a[0][1], b[0][1])
                inter = max(w, 0) * max(h, 0)
                if inter / max(area(a[0]) + area(b[0]) - inter, 1e-9) >= 0.3 or inter / max(min(area(a[0]), area(b[0])), 1e-9) >= 0.6:
                    want.add((image, i, j))
    assert got == want


@pytest.mark.parametrize("by_type", [True, False])
@pytest.mark.parametrize("limit", [0.0, 0.3, 0.7])
def test_suppression(spark, two_pages, limit, by_type):
    _, pred = frames(spark, two_pages)
    got = {r["image"]: [i for i, x in enumerate(r["s"]) if x] for r in pred.select("image", detect.stays(F.col("regions"), limit, by_type).alias("s")).collect()}
    for image, _, regions in two_pages:
        assert got[image] == brute_stays(regions, limit, by_type)
    kept = {r["image"]: len(r["regions"]) for r in detect.suppress(pred, limit, 0.5, by_type).collect()}
    for image, _, regions in two_pages:  # the confidence first, then suppression
        assert kept[image] == len(brute_stays([r for r in regions if r[5] is None or r[5] >= 0.5], limit, by_type))


def test_grid_is_the_metric_of_each_point(spark, two_pages):
    gt, pred = frames(spark, two_pages)
    got = {(r["conf"], r["iou"], r["nms"]): r for r in detect.grid(gt, pred, [0.2, 0.5], [0.3, 0.6], [None, 0.4]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1]["ordinal"])] == [(c, t, m) for c in (0.2, 0.5) for t in (0.3, 0.6) for m in (None, 0.4)]
    for (conf, at, limit), r in got.items():
        kept = detect.suppress(pred, limit, conf) if limit is not None else pred.withColumn("regions", F.filter("regions", lambda x: F.coalesce(x["conf"], F.lit(1.0)) >= conf))
        want = pages.score(pages.score_pages(gt, kept, at)).first()
        for name in want.asDict():
            assert r[name] == pytest.approx(want[name], abs=1e-12), (conf, at, limit, name)


def test_page_of_twenty_thousand_boxes(spark):
    rng = random.Random(6)
    many = [(b, "printed", "", "uk", "legible", 0.5) for b in boxes(rng, 20_000, side=20_000, least=40, most=160)]
    moved = [([v + 1 for v in b], *r) for b, *r in many]
    rng.shuffle(moved)
    gt, pred = frames(spark, [("big", many, moved)])
    both = gt.withColumnRenamed("regions", "g").join(pred.withColumnRenamed("regions", "p"), "image")
    began = time.monotonic()
    (r,) = both.select(F.size(pages.greedy_pairs(F.col("g"), F.col("p"), 0.5)).alias("n")).collect()
    assert r["n"] > 19_500
    assert pages.overlap_pairs(pred, 0.3, 0.9).count() < 200_000
    assert detect.suppress(pred, 0.3).select(F.size("regions").alias("n")).first()["n"] > 15_000
    assert time.monotonic() - began < 60


def test_meeting_boxes_against_all_pairs():
    rng = random.Random(3)
    for _ in range(30):
        a, b = (sweep.boxes(boxes(rng, rng.randrange(0, 40), side=rng.choice([3, 50, 400]), least=0) + [[9.0, 9.0, 3.0, 3.0], None, [1.0]]) for _ in range(2))
        got = sorted((int(i), int(j)) for x, y in sweep.meeting(a, b) for i, j in zip(x, y, strict=True))
        with np.errstate(invalid="ignore"):
            want = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i, 1] < b[j, 3] and b[j, 1] < a[i, 3] and a[i, 0] < b[j, 2] and b[j, 0] < a[i, 2]]
        assert got == want


def test_pages_of_a_batch_against_each_page_alone():
    rng = random.Random(5)
    for crowded in (sweep.CROWDED, 100):
        rows = [boxes(rng, rng.randrange(0, 30), side=80) + [None, [1.0]] if rng.random() < 0.8 else None for _ in range(25)]
        flat, of = sweep.flat(pa.array(rows, pa.list_(pa.list_(pa.float64()))))
        assert of.tolist() == [0, *np.cumsum([len(r or []) for r in rows]).tolist()]
        least = np.array([rng.choice([0.05, 0.3]) for _ in rows])
        before, sweep.CROWDED = sweep.CROWDED, crowded
        o, i, j, ends = sweep.overlapping_on_pages(flat, of, flat, of, least)
        sweep.CROWDED = before
        for k, row in enumerate(rows):
            whole = [(n, b) for n, b in enumerate(row or []) if b is not None and len(b) == 4]
            want = sorted((-iou(a, b), m, n) for m, a in whole for n, b in whole if iou(a, b) >= least[k])
            assert list(zip((-o[ends[k] : ends[k + 1]]).tolist(), i[ends[k] : ends[k + 1]].tolist(), j[ends[k] : ends[k + 1]].tolist(), strict=True)) == want


def test_limits_share_their_pairs(spark, two_pages):
    _, pred = frames(spark, two_pages)
    both = pred.select("image", detect.stays_at(F.col("regions"), [0.0, 0.3, 0.7]).alias("s"))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("stays_large(") == 1
    got = {r["image"]: r["s"] for r in both.collect()}
    for image, _, regions in two_pages:
        assert [[i for i, x in enumerate(s) if x] for s in got[image]] == [brute_stays(regions, m, True) for m in (0.0, 0.3, 0.7)]
