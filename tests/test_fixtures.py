"""How the derived pages are laid out: whatever the file's row groups, texts are matched by all cores."""

import pytest
from pyspark.sql import functions as F

from quirelake.plans import fixtures as fx
from quirelake.plans.crowded import crowded


@pytest.fixture(scope="module")
def one_group(spark, tmp_path_factory):
    """300 documents in a file of a single row group that is read in many splits."""
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(i, "s", None if i == 7 else " \t" if i == 8 else " ".join(f"w{i}x{k}" for k in range(1 + 31 * i % 700))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    yield path
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_splits_without_rows_are_no_spread(spark, one_group):
    docs = fx.table(spark, one_group, "documents")
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    largest = fx.spread(spark, docs).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 150


@pytest.mark.parametrize("of", [fx.pages, crowded])
def test_texts_are_matched_after_the_spreading_alone(spark, one_group, of):
    plan = of(spark, one_group)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Repartition")
    assert above.count("regexp_extract_all") == 1 and "regexp_extract_all" not in below


def test_documents_without_words_have_no_pages(spark, one_group):
    got = {r[0]: r[1] for r in fx.pages(spark, one_group).groupBy("doc_id").agg(F.sum(F.size("regions"))).collect()}
    assert got == {i: -(-(1 + 31 * i % 700) // fx.WORDS) for i in range(300) if i not in (7, 8)}
