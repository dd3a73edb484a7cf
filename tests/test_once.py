"""Queries that score, derive or annotate pages do so once for all that they report."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import compare, pages
from quirelake.plans import fixtures as fx
from quirelake.plans.queries import QUERIES
from quirelake.sources import regions

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sharded_metric", "metric_comparison", "run_comparison", "profile_scores"])
def test_pages_are_scored_in_one_pass(spark, monkeypatch, name):
    calls, score = [], pages._score_joined
    monkeypatch.setattr(pages, "_score_joined", lambda *a: calls.append(1) or score(*a))
    assert QUERIES[name](spark, SMALL).count() > 0
    assert len(calls) == 1


def test_both_kinds_of_suppression_share_a_derivation(spark):
    assert QUERIES["suppressed_regions"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


REGION = "struct<bbox:array<double>,type:string,text:string>"


def test_annotation_measures_boxes_once(spark):
    rows = spark.createDataFrame([("a", [])], f"image string, regions array<{REGION}>")
    plan = compare.annotate(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1.0E-9") == 2


def test_annotation_finds_what_brute_force_finds(spark):
    boxes = [[float(x + d), float(y), float(x + w), float(y + 20)] for x in (0, 100) for y in (0, 3, 30) for d in (0, 1) for w in (50, 52)] + [[5.0, 5.0, 5.0, 9.0]]
    rows = spark.createDataFrame([("a", [(b, "printed", "t") for b in boxes])], f"image string, regions array<{REGION}>")

    def of(i, j):
        a, b = boxes[i], boxes[j]
        inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        x, y = ((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b))
        return inter / max(x + y - inter, 1e-9), inter / max(min(x, y), 1e-9)

    for r in compare.annotate(rows, rows).select("id", "overlap_with", "contained_with", "flags", F.col("raw_text")).collect():
        others = [j for j in range(len(boxes)) if j != r["id"]]
        assert r["overlap_with"] == [j for j in others if of(r["id"], j)[0] >= 0.80]
        assert r["contained_with"] == [j for j in others if of(r["id"], j)[1] >= 0.95]
        assert ("overlap_iou80" in r["flags"]) == bool(r["overlap_with"]) and r["raw_text"] == "t"


def test_strict_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        made.add(1)
        return '[{"bbox": [1, 2, 3, 4], "type": "table"}]'

    rows = spark.range(10).select(F.col("id").cast("string").alias("image"), text("id").alias("regions"))
    assert regions.parse_strict(rows).where("size(regions) = 1").count() == 10 and made.value == 10



def test_a_submissions_checks_read_each_table_once(spark):
    assert QUERIES["submission_checks"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2


def test_checks_count_nulls_and_repeated_images(spark):
    rows = spark.createDataFrame([("a", "[]"), ("a", "[5, {}]"), ("b", "{"), (None, None)], "image string, regions string")
    sample = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "image string")
    got = {r["check"]: (r["ok"], r["observed"]) for r in compare.submission_checks(rows, sample).collect()}
    assert got == {"regions_valid": (False, 3), "images_unique": (False, 1), "no_missing_images": (False, 3), "no_extra_images": (False, 2)}
    assert [r["observed"] for r in compare.submission_checks(rows.limit(0)).collect()] == [0, 0]


def test_a_summary_derives_its_pages_once(spark):
    assert not [f for f in QUERIES["submission_summary"](spark, SMALL).inputFiles() if "documents" in f]


def test_the_first_silver_pages_are_those_of_a_cap_over_all_crops(spark):
    schema = "image string, file_name string, filename string, id string, " + ", ".join(f"{c} {regions._CROP_REGION}" for c in ("regions", "annotations")) + ", page_no long"
    box = lambda k, kind="printed": ([float(k), 0.0, 9.0, 9.0], None, kind, f" t{k} ", "uk", None)
    rows = [(f"p{n}.jpg", None, None, None, [box(k, "image" if k == 1 else "printed") for k in range(n % 4)], None, n) for n in range(30)] + [(None, None, None, None, [box(1)], None, 1)]
    index = spark.createDataFrame([(f"p{n}.jpg" if n % 2 else f"p{n}", f"/x/{n}") for n in range(30) if n % 5], "key string, path string")
    given = spark.createDataFrame(rows, schema)
    every = regions._found_regions(given, index)
    for most in (0, 1, 7, 1000):
        want = regions.cap_by_page(every, most).select("source_image", "bbox", "type", F.col("text").alias("silver_text"))
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, regions.silver_crops_from_lines(given, index, most).collect()))
    assert not [f for f in QUERIES["silver_lines"](spark, SMALL).inputFiles() if "documents" in f]


@pytest.mark.parametrize("name", ["metric_grid", "metric_grid_best", "detector_grid"])
def test_a_grid_derives_its_pages_once(spark, name):
    assert QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


REPORTS = ["page_metric", "report_by_type", "report_page_errors", "report_worst_pages", "report_diagnosis", "metric_comparison", "profile_scores"]


@pytest.mark.parametrize("name", REPORTS)
def test_scored_pages_are_derived_once_and_not_joined(spark, monkeypatch, name):
    plans, score = [], pages._score_joined
    monkeypatch.setattr(pages, "_score_joined", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or score(rows, *a))
    QUERIES[name](spark, SMALL)
    assert len(plans) == 1 and plans[0].count("parquet") == 1 and "Join" not in plans[0]


def test_pages_beside_their_predictions_score_as_joined_ones(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).withColumn("doc_id", F.expr("CASE WHEN doc_id % 7 <> 3 THEN doc_id END"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = pages.score_pages(fx.solution(spark, str(tmp_path)), fx.submission(spark, str(tmp_path)))
    got = pages.score_beside(fx.whole(spark, str(tmp_path)))
    assert got.where("image IS NULL").count() > 0 and got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_variants_beside_their_reference_score_as_joined_ones(spark):
    rows = fx.whole(spark, SMALL).limit(60)
    half = F.filter("pred", lambda r, i: i % 2 == 0)
    own = F.array(F.struct(F.lit("all").alias("name"), F.col("pred").alias("pred")), F.struct(F.lit("half").alias("name"), half.alias("pred")))
    rows = rows.withColumn("own", F.when(~F.col("image").like("%3_0.jpg"), own)).localCheckpoint()
    want = pages.score_own(rows.select("image", "source", F.col("gt").alias("regions")), rows.where("own IS NOT NULL").select("image", "own"), ["all", "half"])
    got = pages.score_own_beside(rows, ["all", "half"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
