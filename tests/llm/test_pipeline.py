import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quirelake.llm import compression

from .conftest import CLASHING, prose
from .test_contamination import brute as contaminated
from .test_jaccard import brute as near
from .test_site_lines import brute as lines


@pytest.fixture(scope="module")
def tables(spark, fixture_rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = [r for r in fixture_rows if r[0] is not None][:-1]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(2).write.parquet(f"{d}/documents.parquet")
    items = [(1, " ".join((rows[10][1] or "").split()[:40])), (2, "nothing like the rest of it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def expected(rows, items):
    z = zstandard.ZstdCompressor(level=3)
    rows = [r for r in rows if compression.measure((r[1] or "").encode(), compression.Limits(), z)[6]]
    by = {}
    for d, t, _ in lines(rows, 0.02, 5):
        by.setdefault(d, []).append(t)
    rows = [(r[0], by[str(r[0])][0]) for r in rows]
    keep = {g for *_, g in near(rows)}
    rows = [r for r in dict(rows).items() if r[0] in keep]
    bad = {d for d, *_, c in contaminated(rows, items) if c}
    return [r for r in rows if str(r[0]) not in bad]


def test_run_against_brute_force(spark, tables):
    d, rows, items = tables
    want = expected(rows, items)
    got = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == {w[0] for w in want}
    whole = {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in got)
    assert np.max([r["offset"] + r["length"] for r in got]) <= 2048


def test_a_large_group_of_copies_keeps_its_text(spark):
    copy = "one page that many rows hold\nin two lines"
    docs = spark.createDataFrame(
        [(i, copy if i < 60 else f"other text {i}", "en", "h", 1) for i in range(120)],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = corpus_pipeline.lines(spark, docs, "")
    assert got.where("doc_id < 60").select("text", "n_chars").distinct().collect() == [(copy, len(copy))]


def test_stages_return_documents(spark, tables):
    d, *_ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def table(spark, rows, d, more=(), items=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for c in more:
        docs = docs.withColumn(c, F.lit("z"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_an_empty_table_goes_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, table(spark, [], tmp_path)).count() == 0


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(21)
    long, plain, other, marked = prose(rng, 30_000), prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [
        (None, plain, None, None, None), (None, other, "en", None, 3), (1, long, None, "s", None), (1, long, None, "s", None),
        (2, long + " ende", None, "s", 1), (3, None, None, None, None), (None, None, None, None, None), (4, "", "en", "s", 0),
        (5, marked, "en", "t", 1)
    ]
    got = corpus_pipeline.run(spark, table(spark, rows, tmp_path, CLASHING, [(1, marked), (None, None), (2, "")])).collect()
    assert len(long) > 100_000
    whole = {}
    for r in got:
        assert r["ids_crc32"] is not None
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert sorted(str(d) for d, _ in whole) == ["1", "None", "None"]
    for (_, n), pieces in whole.items():
        assert [a for a, _ in sorted(pieces)] == [
            sum(x for _, x in sorted(pieces)[:k]) for k in range(len(pieces))
        ] and sum(x for _, x in pieces) == n


def test_stages_pass_other_columns_on(spark, clashing, tmp_path):
    d = table(spark, [], tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, d)
        assert out.columns == clashing.columns and {tuple(r) for r in out.select(*CLASHING).collect()} == {("z",) * len(CLASHING)}
