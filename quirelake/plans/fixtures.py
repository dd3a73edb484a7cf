"""Pages of regions derived from the documents table, by whole-number arithmetic that Spark and SQL share.

Every word of every document is in a region: words are joined by eight, regions are dealt to pages by thirty. Characters beyond ASCII become
@, so that edit distances in bytes and in characters agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import held

WORDS, PER_PAGE = 8, 30
PLAIN = "^[A-Za-z0-9 ,.]*$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gt(d: Column, p: Column, t: Column) -> Column:
    x1, y1 = 50 + (7 * d + 13 * p) % 40, 40 + 36 * p
    k, plain = (31 * d + 17 * p) % 20, t.rlike(PLAIN)
    kind = F.when(k < 12, "handwritten").when(
        k < 15, F.when(plain, "formula").otherwise("handwritten")
    ).when(k == 15, "printed").when(k == 16, "annotation").when(
        k == 17, F.when(plain, "table").otherwise("printed")
    ).when(k == 18, "image").otherwise("graph")
    box = F.array(*[v.cast("double") for v in (x1, y1, x1 + 200 + F.length(t) % 500, y1 + 20 + 4 * ((d + 2 * p) % 5))])
    return F.struct(
        box.alias("bbox"),
        kind.alias("type"),
        t.alias("text"),
        F.when((d + p) % 23 == 0, "other").otherwise("uk").alias("language"),
        F.when((3 * d + p) % 29 == 0, "illegible").otherwise("legible").alias("legibility"),
        F.lit(None).cast("double").alias("conf"),
    )


def _pred(d: Column, p: Column, g: Column) -> Column:
    """The predictions for a reference region: none, one, or one and a duplicate."""
    dx, dy = ((d + p) % 9).cast("double"), F.when((d + p) % 7 == 0, 12).otherwise(p % 5).cast("double")
    box = F.array(g["bbox"][0] + dx, g["bbox"][1] + dy, g["bbox"][2] + dx, g["bbox"][3] + dy)
    plain = g["text"].rlike(PLAIN)
    text = F.when((d + p) % 3 == 0, F.replace(g["text"], F.lit("e"), F.lit("a"))).otherwise(g["text"])
    conf = (((d * 13 + p * 7) % 50) + 50) / 100.0

    def one(kind: Column) -> Column:
        return F.struct(
            box.alias("bbox"), kind.alias("type"), text.alias("text"), F.lit("uk").alias("language"), F.lit("legible").alias("legibility"),
            conf.alias("conf")
        )

    first = one(F.when(((d + p) % 13 == 0) & plain, "formula").otherwise(g["type"]))
    second = one(F.when(plain, "formula").otherwise("printed"))
    none = F.array().cast("array<struct<bbox:array<double>,type:string,text:string,language:string,legibility:string,conf:double>>")
    return F.when((d + 2 * p) % 11 == 0, none).when((d + p) % 19 == 0, F.array(first, second)).otherwise(F.array(first))


def spread(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows dealt to all cores. A file has more splits than row groups, and a split without one has no rows, so splits don't say how rows lie."""
    cores, splits = spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()
    return docs.repartition(max(4 * cores, 8 * splits))


def lines(words: str) -> Column:
    """The words of an array joined by ``WORDS``; null where there are none, so that exploding drops the row. A filter on the words in place of that
    would be pushed below the spreading and match every text once more, where the file's few row groups are read."""
    count = F.size(words)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / WORDS).cast("int")))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i * WORDS + 1, F.lit(WORDS)), " "))


def by_page(parts: str, per_page: int) -> Column:
    """Lists of up to ``per_page`` items of an array; null if that is."""
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / per_page).cast("int")))
    return F.transform(starts, lambda g: F.slice(parts, g * per_page + 1, F.lit(per_page)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, source, doc_id, image_width, image_height, regions and pred: one row per page."""
    docs = spread(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source",
        F.regexp_extract_all(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "@"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w")
    )
    docs = docs.select("doc_id", "source", lines("w").alias("parts"))
    rows = docs.select("doc_id", "source", F.posexplode(by_page("parts", PER_PAGE)).alias("g", "texts"))
    d = F.col("doc_id")
    rows = held(rows.withColumn("regions", F.transform("texts", lambda t, p: _gt(d, p.cast("long"), t))))
    pred = F.flatten(F.transform("regions", lambda r, p: _pred(d, p.cast("long"), r)))
    image = F.concat(F.lit("doc_"), d.cast("string"), F.lit("_"), F.col("g").cast("string"), F.lit(".jpg"))
    return rows.select(
        image.alias("image"), "source", "doc_id", F.lit(800).alias("image_width"), F.lit(1200).alias("image_height"), "regions", pred.alias("pred")
    )


def solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("image", "source", "image_width", "image_height", "regions")


def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("image", F.col("pred").alias("regions"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, source, gt and pred: pages as they are derived, reference and predictions side by side, so that nothing is derived twice or shuffled.

    As in a join on it, a page without an image has no predictions.
    """
    return pages(spark, sf_dir).select("image", "source", F.col("regions").alias("gt"), F.when(F.col("image").isNotNull(), F.col("pred")).alias("pred"))


#: The same as SQL common table expressions: gt and pr, a row for each region.
SQL = rf"""
    w AS (SELECT doc_id, source, regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '@', 'g'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    part AS (SELECT doc_id, source, i // {PER_PAGE} AS g, i % {PER_PAGE} AS p, array_to_string(w[i * {WORDS} + 1 : i * {WORDS} + {WORDS}], ' ') AS t
             FROM (SELECT doc_id, source, w, unnest(generate_series(0, ((len(w) - 1) // {WORDS})::BIGINT)) AS i FROM w WHERE len(w) > 0)),
    gt AS (SELECT 'doc_' || doc_id || '_' || g || '.jpg' AS image, source, doc_id AS d, p AS gi,
             50 + (7 * doc_id + 13 * p) % 40 AS x1, 40 + 36 * p AS y1, 250 + (7 * doc_id + 13 * p) % 40 + length(t) % 500 AS x2, 60 + 36 * p + 4 * ((doc_id + 2 * p) % 5) AS y2,
             CASE WHEN k < 12 THEN 'handwritten' WHEN k < 15 THEN CASE WHEN plain THEN 'formula' ELSE 'handwritten' END WHEN k = 15 THEN 'printed' WHEN k = 16 THEN 'annotation'
                  WHEN k = 17 THEN CASE WHEN plain THEN 'table' ELSE 'printed' END WHEN k = 18 THEN 'image' ELSE 'graph' END AS type,
             t AS text, CASE WHEN (doc_id + p) % 23 = 0 THEN 'other' ELSE 'uk' END AS language, CASE WHEN (3 * doc_id + p) % 29 = 0 THEN 'illegible' ELSE 'legible' END AS legibility, plain
           FROM (SELECT *, (31 * doc_id + 17 * p) % 20 AS k, regexp_matches(t, '{PLAIN}') AS plain FROM part)),
    moved AS (SELECT image, source, d, gi, type, plain, (d + gi) % 9 AS dx, CASE WHEN (d + gi) % 7 = 0 THEN 12 ELSE gi % 5 END AS dy, x1, y1, x2, y2,
             CASE WHEN (d + gi) % 3 = 0 THEN replace(text, 'e', 'a') ELSE text END AS text, ((d * 13 + gi * 7) % 50 + 50) / 100.0 AS conf FROM gt WHERE (d + 2 * gi) % 11 <> 0),
    preds AS (SELECT image, source, 2 * gi AS o, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2, CASE WHEN (d + gi) % 13 = 0 AND plain THEN 'formula' ELSE type END AS type, text, conf FROM moved
              UNION ALL SELECT image, source, 2 * gi + 1, x1 + dx, y1 + dy, x2 + dx, y2 + dy, CASE WHEN plain THEN 'formula' ELSE 'printed' END, text, conf FROM moved WHERE (d + gi) % 19 = 0),
    pr AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY o) - 1 AS pi FROM preds)
"""
