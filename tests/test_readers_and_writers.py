"""Readers, writers and curation helpers that no query covers."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirelake.functions import geometry as G
from quirelake.functions import text as X
from quirelake.operators import compare, curation, pages, postprocess
from quirelake.schema import PAGE
from quirelake.sources import regions as S
from quirelake.sources import sinks
from quirelake.streaming import progress

REGIONS = "array<struct<bbox:array<double>,type:string,text:string>>"


def page(image, regions, source="s", size=(100, 80)):
    full = [(b, k, t, lang, leg, None) for b, k, t, lang, leg in regions]
    return (image, None, None, None, source, *size, full, None, None)


BOX = [10.0, 10.0, 50.0, 30.0]


@pytest.fixture(scope="module")
def some(spark):
    rows = [
        page(
            "d/a.jpg",
            [
                (BOX, "handwritten", "слово", "uk", "legible"), (BOX, "image", "", "uk", "legible"), (BOX, "table", "x", "other", "legible"),
                (BOX, "printed", "y", None, None)
            ]
        ),
        page("b.jpg", [(BOX, "formula", " ", "uk", "legible"), (BOX, None, "z", "uk", "illegible")], None),
        page("c.jpg", []),
    ]
    return spark.createDataFrame(rows, PAGE)


def test_sizes_and_solution(spark, some, tmp_path):
    tests = spark.createDataFrame([("x/t.jpg", 10, 20, None)], "file_name string, image_width int, image_height int, source string")
    assert tuple(S.page_sizes(tests).first()) == ("t.jpg", 10, 20, "unknown")
    got = {r["image"]: (r["source"], len(r["regions"])) for r in curation.valid_solution(some).collect()}
    assert got == {"d/a.jpg": ("s", 4), "b.jpg": ("unknown", 2), "c.jpg": ("s", 0)}
    sinks.write_solution_csv(some, str(tmp_path / "gt"))
    back = S.parse_strict(spark.read.option("header", True).option("escape", "\"").csv(str(tmp_path / "gt")).select("image", "regions"))
    assert {r["image"]: [x["text"] for x in r["regions"]] for r in back.collect()}["d/a.jpg"] == ["слово", "", "x", "y"]


def test_histograms_and_filters(some, spark):
    assert {r["type"]: r["n"] for r in curation.type_histogram(some).collect()} == {
        "handwritten": 2, "image": 1, "table": 1, "printed": 1, "formula": 1
    }
    assert [r["image"] for r in curation.of_sources(some, ["s"]).select("image").collect()] == ["d/a.jpg", "c.jpg"]
    crops = spark.createDataFrame(
        [("a", "ok", 20, 20), ("b", "x", 20, 20), ("c", "fine", 9, 20), ("d", "fine", None, None)], "image string, text string, width int, height int"
    )
    assert [r["image"] for r in curation.external_quality(crops).collect()] == ["a", "d"]


def test_crops(some):
    got = [tuple(r) for r in S.crops(some, "train", 1.0).select("image_path", "idx", "type").orderBy("image_path").collect()]
    assert got == [("train/a_r000000.jpg", 0, "handwritten"), ("train/a_r000001.jpg", 3, "printed")]
    assert S.silver_crops(some).where("weight = 0.5").count() == 4


def test_crops_from_lines(spark, tmp_path):
    region = lambda text, **more: {"bbox": [1, 2, 30, 40], "text": text} | more
    lines = [
        {
            "image": "a.jpg",
            "regions": [region(" один  два "), region("", type="printed"), region("три", bbox=None, bbox_2d=[1, 1, 9, 9], type="table")]
        },
        {"file_name": "gone.jpg", "regions": [region("ні")]},
        {
            "id": "b",
            "annotations": [region("чотири", language="other"), region("п'ять", legibility="illegible"), region("шість"), region("сім", type="graph")]
        },
        {"image": "c.jpg", "regions": [region("вісім")]},
    ]
    (tmp_path / "p.jsonl").write_text(
        "\n".join([json.dumps(x, ensure_ascii=False) for x in lines[:2]] + ["{bad", ""] + [json.dumps(x, ensure_ascii=False) for x in lines[2:]]),
        encoding="utf-8"
    )
    index = S.image_index(spark.createDataFrame([("/r/a.jpg",), ("/r/b.png",), ("/r/c.jpg",)], "path string"), "/r", last_wins=True)
    pages_ = S.read_crop_pages(spark, str(tmp_path / "p.jsonl"))
    got = sorted(tuple(r) for r in S.crops_from_lines(pages_, index, "gold").select("image_path", "source_image", "text", "type").collect())
    assert got == [
        ("a_r000000.jpg", "/r/a.jpg", "один два", "handwritten"), ("a_r000001.jpg", "/r/a.jpg", "три", "table"),
        ("b_r000002.jpg", "/r/b.png", "шість", "handwritten"), ("c_r000003.jpg", "/r/c.jpg", "вісім", "handwritten")
    ]
    for most, n in ((1, 2), (2, 2), (3, 3), (4, 4)):  # the limit is tested before a page, so one page may pass it
        assert sorted(r["image_path"] for r in S.crops_from_lines(pages_, index, "gold", most=most).collect()) == [g[0] for g in got[:n]]
    assert S.crops_from_lines(S.read_crop_pages(spark, str(tmp_path / "none")), index, "gold").count() == 0


def test_silver_crops_from_lines(spark, tmp_path):
    region = lambda text, **more: {"bbox": [1, 2, 30, 40], "text": text} | more
    lines = [
        {"image": "a.jpg", "regions": [region(" один "), region(""), region("x", type="image"), region("y", bbox=None)]},
        {"image": "gone.jpg", "regions": [region("ні")]},
        {"id": "b", "annotations": [region("два", legibility="illegible"), region("ні", language="other")]},
        {"image": "c.jpg", "regions": [region("три", bbox=[], bbox_2d=[1, 1, 9, 9])]},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    index = S.image_index(spark.createDataFrame([("/r/a.jpg",), ("/r/b.png",), ("/r/c.jpg",)], "path string"), "/r", last_wins=True)
    pages_ = S.read_crop_pages(spark, str(tmp_path / "p.jsonl"))
    want = [("/r/a.jpg", ""), ("/r/a.jpg", "один"), ("/r/b.png", "два"), ("/r/c.jpg", "три")]
    for most, n in ((None, 4), (0, 0), (1, 2), (2, 2), (3, 3), (4, 4)):
        got = S.silver_crops_from_lines(pages_, index, most).select("source_image", "silver_text").collect()
        assert sorted(map(tuple, got)) == want[:n]


def test_manifests_joined(spark, tmp_path):
    new = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", None)], "image_path string, weight double")
    assert S.with_earlier(spark, new, str(tmp_path / "none")).collect() == new.collect()
    old = spark.createDataFrame([("a", "1.5", "x"), ("c", "no number", None)], "image_path string, weight string, text string")
    sinks.write_manifest(old, str(tmp_path / "m"))
    both = S.with_earlier(spark, new, str(tmp_path / "m"))
    assert both.schema["weight"].dataType.simpleString() == "double"
    assert Counter(tuple(r) for r in both.select("image_path", "weight", "text").collect()) == Counter(
        [("a", 1.5, "x"), ("c", None, None), ("a", 0.5, None), ("a", 0.5, None), ("b", None, None)]
    )
    assert S.with_earlier(spark, new.limit(0), str(tmp_path / "m")).count() == 2


def test_lookup_orders(spark):
    index = S.image_index(spark.createDataFrame([("/r/x/a.jpg",), ("/r/b.jpg",)], "path string"), "/r")
    names = spark.createDataFrame([("images/a.jpg",), ("zzz/b.jpg",), ("b.gif",)], "name string")
    found = lambda order: {r["name"]: r["path"] for r in S.resolve_images(names, index, order).collect()}
    assert found(S.WHOLE_OR_STEM) == {"images/a.jpg": "/r/x/a.jpg", "zzz/b.jpg": "/r/b.jpg", "b.gif": "/r/b.jpg"}
    assert found(("whole",)) == {"images/a.jpg": "/r/x/a.jpg", "zzz/b.jpg": None, "b.gif": None}
    assert found(S.BASE_FIRST)["zzz/b.jpg"] == "/r/b.jpg"


def test_missing_paths(spark, tmp_path):
    gone = str(tmp_path / "gone.jsonl")
    assert S.read_pages(spark, gone, strict=True, may_miss=True).count() == 0
    for args in ({"strict": True}, {"may_miss": False}):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            S.read_pages(spark, gone, **args).count()


def test_labels_and_words(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.txt").write_text("0 .1 .2 .3 .4\n2 .1 .2 .3 .4\n\n")
    (tmp_path / "labels" / "b.txt").write_text("2 .1 .2 .3 .4\n")
    assert {r["class"]: r["n"] for r in S.label_file_counts(spark, str(tmp_path / "labels")).collect()} == {0: 1, 2: 2}
    (tmp_path / "w.txt").write_text(" ab \nc\n\ndef\n")
    assert [r["word"] for r in S.read_word_list(spark, [str(tmp_path / "no.txt"), str(tmp_path / "w.txt")]).collect()] == ["ab", "def"]
    assert S.read_word_list(spark, [str(tmp_path / "no.txt")]).count() == 0
    (tmp_path / "l.csv").write_text("Filename,Transcription\ng.png,слово\n", encoding="utf-8")
    got = S.first_external_labels(spark, [(str(tmp_path / "no.json"), "map"), (str(tmp_path / "l.csv"), "csv"), (str(tmp_path / "labels"), "files")])
    assert [tuple(r) for r in got.collect()] == [("g.png", "слово")]
    assert S.first_external_labels(spark, [(str(tmp_path / "no"), "map")]).count() == 0
    assert sorted(r["length"] for r in S.list_files(spark, str(tmp_path / "labels"), "*.txt").collect()) == [14, 29]


def test_jitter(spark):
    box = spark.range(200).select(F.array(*[(F.col("id") + k).cast("double") for k in (100, 100, 200, 150)]).alias("b"))
    moved = box.select(
        G.crop_rect(F.col("b"), F.lit(10_000), F.lit(10_000)).alias("p"),
        G.crop_rect(F.col("b"), F.lit(10_000), F.lit(10_000), jitter=3, seed=1).alias("j")
    ).collect()
    off = [[y - x for x, y in zip(r["p"], r["j"], strict=True)] for r in moved]
    assert {v for o in off for v in o} == set(range(-3, 4)) and len({tuple(o) for o in off}) > 100


def test_writers(spark, some, tmp_path):
    sinks.write_jsonl(some.select("image", "source"), str(tmp_path / "j"))
    assert {(r["image"], r["source"]) for r in spark.read.json(str(tmp_path / "j")).collect()} == {("d/a.jpg", "s"), ("b.jpg", None), ("c.jpg", "s")}
    sinks.write_manifest(spark.createDataFrame([("a", [1.0, 2.0], 'q"t')], "image_path string, bbox array<double>, text string"), str(tmp_path / "m"))
    assert tuple(S.read_manifest(spark, str(tmp_path / "m")).first()) == ("a", "[1.0,2.0]", 'q"t')
    sinks.write_detector_labels(some.withColumn("image", S.stem(F.col("image"))), str(tmp_path / "d"))
    lines = spark.read.text(str(tmp_path / "d")).where("value <> ''").collect()
    assert sorted(r["value"].split()[0] for r in lines) == ["0", "0", "1", "2", "3", "5"] and all(
        r["value"].endswith("0.300000 0.250000 0.400000 0.250000") for r in lines
    )


def test_reports(spark, tmp_path):
    one, many = spark.createDataFrame([(0.5, None)], "score double, x string"), spark.range(5)
    got = sinks.report({"metric": one, "detail": {"rows": many, "note": "так"}}, most=3)
    assert got == {
        "metric": {"score": 0.5, "x": None}, "detail": {"rows": {"rows": [{"id": 0}, {"id": 1}, {"id": 2}], "truncated": True}, "note": "так"}
    }
    sinks.write_report(spark, {"metric": one, "detail": {"n": 1}}, str(tmp_path / "r"))
    whole = lambda name: spark.read.text(str(tmp_path / name), wholetext=True).first()[0]
    assert json.loads(whole("r/json")) == {"metric": {"score": 0.5, "x": None}, "detail": {"n": 1}}
    assert "## metric" in whole("r/markdown")


def test_viewer(spark):
    raw = spark.createDataFrame(
        [("a", [(BOX, "printed", "x" * 200), (BOX, "formula", "y"), ([0.0, 0.0, 5.0, 5.0], "table", "z")]), ("b", [])],
        f"image string, regions {REGIONS}"
    )
    kept = raw.withColumn("regions", F.slice("regions", 1, 2))
    told, gone = compare.annotate(kept, raw), compare.removed(kept, raw)
    assert tuple(compare.candidate_totals(told, gone).first()) == (2, 6, 1)  # two overlaps, two containments, one long text, one run of a character
    shown = {r["image"]: json.loads(r["json"]) for r in sinks.viewer_json(told).collect()}
    assert [x["type"] for x in shown["a"]] == ["printed", "formula"] and "long_text" in shown["a"][0]["flags"]
    rows = told.groupBy("image").agg(F.collect_list(F.struct("type", "text", "flags")).alias("regions")).withColumn("source", F.lit("s"))
    count = lambda **k: compare.filter_pages(rows, **k).count()
    assert (count(), count(source="t"), count(flagged=True), count(query="FORM"), count(query="zz")) == (1, 0, 1, 1, 0)


def test_overlaps_and_long_texts(spark):
    rows = spark.createDataFrame(
        [
            ("a", [(BOX, "printed", "x" * 180), (BOX, "formula", "y" * 200), ([0.0, 0.0, 5.0, 5.0], "table", "z"), ([1.0] * 4, "table", "")]),
            ("b", [(BOX, "printed", "x" * 180)])
        ],
        f"image string, regions {REGIONS}"
    )
    assert pages.overlap_count(rows).first()["overlap_pairs"] == 1
    assert [
        (r["image"], r["length"], len(r["text_head"])) for r in postprocess.long_examples(rows, 2, 20).collect()
    ] == [("a", 200, 20), ("b", 180, 20)]


def test_text_keys(spark):
    rows = spark.createDataFrame([("​Ａb\x07\r\nc  ",), ("«Сло-во», ТАК!  2",), (None,)], "t string")
    got = rows.select(
        X.sanitize(F.col("t")).alias("s"), X.plain_key(F.col("t")).alias("p"), X.compact(F.col("t")).alias("c"), X.plain_key_v2(F.col("t")).alias("v")
    ).collect()
    assert (got[0]["s"], got[1]["p"], got[1]["c"], got[1]["v"]) == ("Ab\nc", "сло-во так 2", "слововтак2".replace("вт", "т"), "сло-во так 2")
    assert all(v == "" for v in got[2])


def test_exact_sample(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 100, 9.0).when(F.col("id") < 110, 0.0).otherwise(1.0).alias("sample_weight"))
    got = {r["id"]: r["draws"] for r in curation.weighted_sample(rows, 2000, digits=1).collect()}
    assert sum(got.values()) == 2000 and not set(range(100, 110)) & set(got)
    assert abs(sum(n for i, n in got.items() if i < 100) - 2000 * 900 / 1290) < 120
    for same in (curation.weighted_sample(rows.repartition(7), 2000), curation.weighted_sample(rows.orderBy(F.desc("id")), 2000, digits=2)):
        assert {r["id"]: r["draws"] for r in same.collect()} == got
    keyed = {r["id"]: r["draws"] for r in curation.weighted_sample(rows.unionByName(rows.where("id = 3")), 2000, "id").collect()}
    assert sum(keyed.values()) == 2000
    one = {r["id"]: r["draws"] for r in curation.weighted_sample(rows.where("id = 3"), 1000).collect()}
    assert one == {3: 1000} and curation.weighted_sample(rows.where("id = 105"), 10).count() == 0


def test_quota_against_plain_order(spark):
    import hashlib

    kinds = {i: "ab"[i % 7 == 0] for i in range(400)}
    rows = spark.createDataFrame([(str(i), k) for i, k in kinds.items()], "image_path string, type string")
    for n in (1, 20, 150, 399):
        h = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
        count = Counter(kinds.values())
        roots = {k: c**0.5 for k, c in count.items()}
        quota = {k: max(1, round(n * r / sum(roots.values()))) for k, r in roots.items()}
        order = {k: sorted((i for i in kinds if kinds[i] == k), key=h) for k in count}
        late = sorted(kinds, key=lambda i: (order[kinds[i]].index(i) >= quota[kinds[i]], h(i)))
        assert {r["image_path"] for r in curation.sqrt_quota(rows, n).collect()} == {str(i) for i in late[:n]}


def test_ranks_over_many_parts(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("t")).repartition(9)
    got = curation.ranked(rows, ["v"]).collect()
    assert sorted((r["v"], r["rank"]) for r in got) == [(v, v + 1) for v in range(1000)]
    three = curation.repeat_to(rows, 2300, "v").groupBy("v").count().collect()
    assert {(r["v"], r["count"]) for r in three} == {(v, 3 if v < 300 else 2) for v in range(1000)}
    assert {r["v"] for r in curation.repeat_to(rows, 10, "v").collect()} == set(range(10)) and curation.repeat_to(rows, 2000, "v").count() == 2000


def test_split_of_nulls_and_copies(spark):
    rows = spark.createDataFrame([(f"p{i % 90}", "s") for i in range(100)] + [(None, None), ("q", None)] * 3, "image string, source string")
    got = curation.stratified_split(rows).collect()
    assert len(got) == 106
    for image, source in {(r["image"], r["source"]) for r in got}:  # copies stand on one side
        assert len({r["split"] for r in got if (r["image"], r["source"]) == (image, source)}) == 1


def test_stages(spark, tmp_path):
    target = spark.createDataFrame([(i, f"p{i}", "s", [], None, None) for i in range(5)], progress.RECORD)
    stage = lambda name, least: progress.Stage(name, *(str(tmp_path / f"{name}-{x}") for x in ("log", "state", "cp")), lambda due, log: progress.append(due.where(F.col("seq") >= least).withColumn("conf", F.lit(0.5)), log))
    assert progress.run_stages(spark, target, [stage("one", 2), stage("two", 4)]) == {"one": 3, "two": 1}
    assert progress.run_stages(spark, target, [stage("one", 0), stage("two", 0)]) == {"one": 5, "two": 5}
    assert progress.run_stages(spark, target, [stage("one", 0), stage("two", 0)], seconds=0.0) == {}


def test_old_versions_go(spark, tmp_path):
    log, state, cp = (str(tmp_path / x) for x in ("log", "state", "cp"))
    for k in range(5):
        progress.append(spark.createDataFrame([(k, "a", "s", [], None, None)], progress.RECORD), log)
        assert progress.upsert(spark, log, state, cp, buckets=2)
    assert progress.read_state(spark, state).select("image", "seq").collect() == [("a", 4)]
    assert [len(v) for v in progress._versions(spark, state).values()] == [2]
