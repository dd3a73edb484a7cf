from pyspark.sql import functions as F

from quirelake.functions.prompts import prompts
from quirelake.sources import config
from quirelake.sources import regions as S


def test_settings(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"best": {"conf": 0.3}}')
    got = config.settings(spark, str(p), {"conf": 0.2, "size": 1024, "flag": False}, {"SIZE": "640", "FLAG": "true"}, "best")
    assert got == {"conf": 0.3, "size": 640, "flag": True}
    assert config.settings(spark, str(tmp_path / "no"), {"a": 1}, {}) == {"a": 1}


def test_artefacts(spark, tmp_path):
    assert config.latest_checkpoint(["checkpoint-20", "checkpoint-100", "x"]) == "checkpoint-100"
    (tmp_path / "a.jsonl").write_text("1\n")
    (tmp_path / "b.jsonl").write_text("1\n\n2\n")
    assert config.most_progress(spark, [str(tmp_path / n) for n in ("none", "a.jsonl", "b.jsonl")]).endswith("b.jsonl")
    assert config.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "*.jsonl")]).endswith("a.jsonl")


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_path,text,weight\nb,t,\na,u,0.7\n")
    got = S.read_manifest(spark, str(tmp_path / "m.csv"), 2, defaults={"weight": 0.3, "source": "synth"}).collect()
    assert [(r["image_path"], r["weight"], r["source"]) for r in got] == [("a", 0.7, "synth"), ("b", 0.3, "synth")]


def test_detections(spark):
    rows = spark.createDataFrame(
        [("a", 0, 0, 5, 5, 2, 0.5), ("a", 1, 1, 5, 5, 0, 0.9), ("a", 1, 1, 2, 2, 0, 0.1)],
        "image string, x1 int, y1 int, x2 int, y2 int, class int, conf double"
    )
    got = S.detections_to_regions(rows, 0.2).first()["regions"]
    assert [r["type"] for r in got] == ["handwritten", "formula"]


def test_prompts(spark):
    row = spark.createDataFrame([("table",), (None,)], "k string").select(prompts(F.col("k")).alias("p")).collect()
    assert "|" in row[0]["p"]["system"] and row[1]["p"]["user"] == "Transcribe this handwritten region exactly:"
