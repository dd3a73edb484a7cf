import pytest
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.operators import compare, curation
from quirelake.sources import regions as S
from quirelake.sources import sinks


@pytest.mark.parametrize("n,valid", [(1, 1), (4, 1), (50, 10), (51, 20), (200, 20), (201, 20), (450, 45)])
def test_split_counts(spark, n, valid):
    rows = spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("image"), F.lit("s").alias("source"))
    got = curation.stratified_split(rows)
    assert got.where("split = 'valid'").count() == valid and got.count() == n


def test_type_weights(spark):
    rows = spark.createDataFrame([("printed",)] * 100 + [("formula",)] * 25 + [("TABLE",)] * 1 + [(None,)] * 4, "type string")
    got = {r["type"]: r["multiplier"] for r in curation.type_weights(rows).collect()}
    assert got == {"printed": 1.0, "formula": 2.0, "table": 4.0, "handwritten": 4.0}


def test_leakage(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "image string"), spark.createDataFrame([("y",)], "image string")
    with pytest.raises(curation.Leakage, match="y"):
        curation.assert_no_leakage(a, b)
    curation.assert_no_leakage(a.where("image = 'x'"), b)


def test_union_and_curriculum(spark):
    a = spark.createDataFrame([("i", 2.0, "b")], "image_path string, weight double, bbox string")
    b = spark.createDataFrame([("j", "t")], "image_path string, silver_text string")
    got = curation.curriculum({"gold": a, "silver": b, "synth": b.drop("silver_text")}, 0).collect()
    assert sorted((r["origin"], r["weight"]) for r in got) == [("gold", 2.0), ("silver", 0.5), ("synth", 0.3)]
    assert [r["origin"] for r in curation.curriculum({"gold": a, "silver": b}, 2).collect()] == ["gold"]


def test_quota_repeat_and_cap(spark):
    rows = spark.range(100).select(F.col("id").alias("image_path"), F.when(F.col("id") < 90, "a").otherwise("b").alias("type"))
    got = {r["type"]: r["n"] for r in curation.sqrt_quota(rows, 20).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 15, "b": 5}
    assert curation.sqrt_quota(rows, 1000).count() == 100
    assert curation.repeat_to(rows, 250, "image_path").count() == 250
    assert S.cap_by_page(spark.range(30).select((F.col("id") / 10).cast("long").alias("page_no")), 11).count() == 20


def test_weighted_sample(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1000, 3.0).otherwise(1.0).alias("sample_weight"))
    got = curation.weighted_sample(rows, 8000).groupBy((F.col("id") < 1000).alias("heavy")).agg(F.sum("draws").alias("n")).collect()
    n = {r["heavy"]: r["n"] for r in got}
    assert abs(n[True] - 6000) < 400 and abs(n[False] - 2000) < 300


def test_audit(spark):
    regions = [([0.0, 0.0, 1.0, 1.0], "handwritten", "слово", "uk", "legible", None)] * 12 + [([0.0, 0.0, 1.0, 1.0], "table", " ", None, None, None)]
    from quirelake.schema import PAGE

    page = spark.createDataFrame([("a", None, None, None, "s", 10, 10, regions, None, None)], PAGE)
    got = curation.audit(page).first()
    assert (
        got["total_regions"], got["scorable_regions"], got["scorable_ratio"], got["avg_text_len"], got["rare_types"]
    ) == (13, 12, 0.9231, 5.0, ["printed", "formula", "table", "annotation", "image", "graph"])


def test_model_seam_halves_batches(spark):
    def predict(kind, frame):
        if len(frame) > 2:
            raise MemoryError
        return [f"{kind}:{i}" for i in frame["i"]]

    rows = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(9)], "i int, type string")
    got = {r["i"]: r["text"] for r in curation.run_model(rows, predict).collect()}
    assert got == {i: f"{'a' if i % 2 else 'b'}:{i}" for i in range(9)}


def test_geometry(spark):
    row = spark.createDataFrame(
        [([10.0, 20.0, 110.0, 60.0], [0.2, 0.2, 0.3, 0.3], [5.0, 5.0, 8.0, 30.0])], "a array<double>, u array<double>, s array<double>"
    )
    w, h = F.lit(200.0), F.lit(100.0)
    got = row.select(
        G.normalized_box(F.col("a"), w, h).alias("a"), G.normalized_box(F.col("u"), w, h).alias("u"), G.normalized_box(F.col("s"), w, h).alias("s"),
        G.resized(F.lit(1000), F.lit(256)).alias("r"), G.iou_metric(F.col("a"), F.col("a")).alias("i"), G.iou(F.col("s"), F.col("a")).alias("z")
    ).first()
    assert got["a"] == pytest.approx([0.3, 0.4, 0.5, 0.4]) and got["u"] == [0.2, 0.2, 0.3, 0.3] and got["s"] is None
    assert tuple(got["r"]) == (500, 128) and got["i"] == 1.0 and got["z"] == 0.0


def test_compare(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("y", 3.0), ("z", 4.0)], "metric string, value double")
    got = {r["metric"]: (r["baseline"], r["candidate"], r["delta"]) for r in compare.compare_metrics(a, b).collect()}
    assert got == {"x": (1.0, None, None), "y": (2.0, 3.0, 1.0), "z": (None, 4.0, None)}


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "pages.jsonl"
    p.write_text('{"image": "a.jpg", "regions": [{"bbox": [1, 2, 30, 40], "text": "ї"}]}\n\n{bad\n{"file_name": "d/b.jpg"}\n', encoding="utf-8")
    got = S.read_pages(spark, str(p)).select(
        S.first_text("image", "file_name").alias("n"), F.size(S.first_list("regions", "annotations")).alias("k")
    ).collect()
    assert sorted(map(tuple, got)) == [("a.jpg", 1), ("d/b.jpg", 0)]
    with pytest.raises(Exception):
        S.read_pages(spark, str(p), strict=True).collect()
    assert S.read_pages(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert S.row_count(spark, str(p)) == 3 and S.row_count(spark, str(tmp_path / "no")) == 0
    rows = spark.createDataFrame(
        [("a", [([1.5, 2.5, 3.0, 4.0], "table", ' "x",\n y ')])], "image string, regions array<struct<bbox:array<double>,type:string,text:string>>"
    )
    sinks.write_region_csv(rows, str(tmp_path / "out"))
    back = S.parse_strict(S.read_region_csv(spark, str(tmp_path / "out"))).first()
    assert back["regions"][0]["bbox"] == [2.0, 2.0, 3.0, 4.0] and back["regions"][0]["text"] == '"x",\n y'
    (tmp_path / "map.json").write_text('{"f.png": "текст"}', encoding="utf-8")
    assert [tuple(r) for r in S.read_external_labels(spark, str(tmp_path / "map.json"), "map").collect()] == [("f.png", "текст")]
    (tmp_path / "l.csv").write_text("File,Label\ng.png,слово\n", encoding="utf-8")
    assert [tuple(r) for r in S.read_external_labels(spark, str(tmp_path / "l.csv"), "csv").collect()] == [("g.png", "слово")]
    assert "| a |" in sinks.markdown("T", [("t", rows.select("image"))])


def test_image_lookup(spark):
    paths = spark.createDataFrame([("/r/x/a.jpg",), ("/r/y/a.png",), ("/r/b.jpg",)], "path string")
    index = S.image_index(paths, "/r")
    names = spark.createDataFrame([("a.jpg",), ("images/b.jpg",), ("zzz/a.gif",), ("q",)], "name string")
    got = {r["name"]: r["path"] for r in S.resolve_images(names, index).collect()}
    assert got == {"a.jpg": "/r/x/a.jpg", "images/b.jpg": "/r/b.jpg", "zzz/a.gif": "/r/x/a.jpg", "q": None}
    assert {r["key"]: r["path"] for r in S.image_index(paths, "/r", last_wins=True).collect()}["a"] == "/r/y/a.png"
