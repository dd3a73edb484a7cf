"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``: the columns doc_id, text and source are read, any others are passed
on as they are, whatever their names, and all but the last stage return the columns that they got. Nulls may stand in any column, ids may be
null or repeat, texts may be of any length, and an empty table goes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.compression import keep_quality
from quirelake.llm.jaccard import keep_one_of_each
from quirelake.llm.packing import pack
from quirelake.llm.scratch import cut
from quirelake.llm.site_lines import drop_site_lines
from quirelake.llm.wumanber import drop_contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression bands and base rules keep. Null, empty and short texts go; each row is judged alone, repeated ones alike."""
    return keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that are boilerplate of their source; n_chars, if there is one, is counted again.

    Rows of one source with the same text are one page, so copies don't make boilerplate of their own lines. A null source is one of its own
    with the empty one; a null text stays null (and has no n_chars); a text may end empty.
    """
    out = drop_site_lines(docs, distinct_pages=True, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): one of the least id. Rows that repeat id and text are one.

    Of texts without words those with the same signs, white space aside, are one; so are empty and null ones. Rows of different texts stay whatever their ids, null ones included.
    """
    return keep_one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in windows of benchmark items. Null and empty texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 tokens; a null or empty text is its end token alone."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near), ("decontamination", benchmarks), ("packing", packing)]

#: Compression ratios and tokenizers have no SQL; a brute-force version stands in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents.parquet in ``sf_dir``; between stages rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{i}")
    return docs
