"""Queries over readers and writers, with their SQL beside them: what the given tables give is written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAGE, REGION_TYPES, REGIONS
from ..sources import regions as sources
from ..sources import sinks
from ..sources.shared import fresh_folder
from ..streaming import progress
from . import fixtures as fx
from .fixtures import SQL as FIXTURE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference pages with all columns of pages."""
    p = fx.pages(spark, sf_dir)
    have = {"image": F.col("image"), "source": F.col("source"), "regions": F.col("regions")} | {c: F.col(c) for c in ("image_width", "image_height")}
    return p.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAGE.fields])


def _chars(regions: str = "regions"):
    return F.aggregate(regions, F.lit(0).cast("long"), lambda n, r: n + F.length(r["text"]))


@query(f"""WITH {FIXTURE}, p AS (SELECT image, any_value(source) AS source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM gt GROUP BY image)
    SELECT mode, p.* FROM p, (VALUES ('lenient'), ('strict')) AS m(mode)""")
def jsonl_pages(spark, sf_dir):
    """Pages as JSON Lines, read strictly; and leniently from a folder that also holds a broken line for each document."""
    folder = fresh_folder(spark, "jsonl")
    rows = _page_rows(spark, sf_dir)
    sinks.write_jsonl(rows, f"{folder}/whole")
    sinks.write_jsonl(spark.read.schema(PAGE).json(f"{folder}/whole"), f"{folder}/mixed")
    broken = F.concat(F.lit('{"image": "doc_'), F.col("doc_id").cast("string"), F.lit('.jpg", "regions": [{"bbox": [1, '))
    fx.table(spark, sf_dir, "documents").select(broken.alias("value")).write.mode("append").text(f"{folder}/mixed")
    read = {"strict": sources.read_pages(spark, f"{folder}/whole", strict=True), "lenient": sources.read_pages(spark, f"{folder}/mixed")}
    one, two = (
        r.select(F.lit(mode).alias("mode"), "image", "source", F.size("regions").cast("long").alias("n"), _chars().alias("chars")) for mode, r in read.items()
    )
    return one.unionByName(two)


@query(f"""WITH {FIXTURE}, p AS (SELECT DISTINCT image FROM gt)
    SELECT image, count(pr.pi) AS n, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(sum(x1 + 3 * y1 + 5 * x2 + 7 * y2), 0)::BIGINT AS boxes,
      coalesce(string_agg(type, ',' ORDER BY pi), '') AS types FROM p LEFT JOIN pr USING (image) GROUP BY image""")
def submission_file(spark, sf_dir):
    """The submission as CSV with regions as JSON text, read back and parsed strictly."""
    folder = fresh_folder(spark, "submission")
    sinks.write_region_csv(fx.submission(spark, sf_dir), folder)
    read = sources.parse_strict(sources.read_region_csv(spark, folder))
    boxes = F.aggregate("regions", F.lit(0.0), lambda n, r: n + r["bbox"][0] + 3 * r["bbox"][1] + 5 * r["bbox"][2] + 7 * r["bbox"][3])
    types = F.array_join(F.transform("regions", lambda r: r["type"]), ",")
    return read.select("image", F.size("regions").cast("long").alias("n"), _chars().alias("chars"), boxes.cast("long").alias("boxes"), types.alias("types"))


@query(f"""WITH {FIXTURE} SELECT image || '#' || gi AS image_path, type, text, x1::BIGINT AS x1, 0.5::DOUBLE AS weight FROM gt ORDER BY image_path LIMIT 500""")
def manifest_head(spark, sf_dir):
    """The first 500 rows of a written manifest by path, boxes as JSON text, the weight that it lacks filled in."""
    folder = fresh_folder(spark, "manifest")
    rows = fx.solution(spark, sf_dir).select("image", F.posexplode("regions").alias("gi", "r"))
    path = F.concat("image", F.lit("#"), F.col("gi").cast("string"))
    sinks.write_manifest(rows.select(path.alias("image_path"), "r.type", "r.text", "r.bbox"), folder)
    read = sources.read_manifest(spark, folder, most=500, defaults={"weight": 0.5})
    x1 = F.from_json("bbox", "array<double>")[0].cast("long")
    return read.select("image_path", "type", "text", x1.alias("x1"), "weight")


@query(f"""WITH {FIXTURE} SELECT list_position([{", ".join(f"'{t}'" for t in REGION_TYPES)}], type)::INTEGER - 1 AS class, count(*) AS n FROM gt GROUP BY type""")
def label_classes(spark, sf_dir):
    """Classes in written detector labels, many pages' labels a file."""
    folder = fresh_folder(spark, "labels")
    sinks.detector_labels(fx.pages(spark, sf_dir)).select("label").write.text(folder)
    return sources.label_file_counts(spark, folder)


@query(f"""WITH {FIXTURE} SELECT image, text FROM gt WHERE gi = 0""")
def external_labels(spark, sf_dir):
    """Labels of the first source that is there: a CSV whose columns go by other names."""
    folder = fresh_folder(spark, "external")
    first = fx.solution(spark, sf_dir).select(F.col("image").alias("Filename"), F.col("regions")[0]["text"].alias("Transcription"))
    first.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/csv")
    return sources.first_external_labels(spark, [(f"{folder}/none.json", "map"), (f"{folder}/csv", "csv")])


@query(rf"""WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS word FROM documents)
    SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY word""")
def corpus_words(spark, sf_dir):
    """A word list of the first path that is there, a word a line: words of two characters or more and how often each stands."""
    folder = fresh_folder(spark, "words")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORD), F.lit(0))
    fx.spread(spark, fx.table(spark, sf_dir, "documents")).select(F.explode(words).alias("value")).write.text(f"{folder}/list")
    return sources.read_word_list(spark, [f"{folder}/none.txt", f"{folder}/list"]).groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT 'written' AS file, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'missing', 0""")
def written_lines(spark, sf_dir):
    """Lines of a written file, blank ones not counted; none of a missing one."""
    folder = fresh_folder(spark, "lines")
    line = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("doc_id").cast("string"))
    fx.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(f"{folder}/a")
    found = [("written", sources.row_count(spark, f"{folder}/a")), ("missing", sources.row_count(spark, f"{folder}/b"))]
    return spark.createDataFrame(found, "file string, n long")


@query(f"""WITH {FIXTURE}, p AS (SELECT image, greatest('/root/' || coalesce(any_value(source), 'none') || '/' || image, '/root/zz/' || image) AS path FROM gt GROUP BY image)
    SELECT image AS key, path FROM p UNION ALL SELECT replace(image, '.jpg', ''), path FROM p""")
def image_index_last(spark, sf_dir):
    """Images by base name and stem where the last path by name keeps a key; each lies in two folders."""
    p = fx.solution(spark, sf_dir)
    at = lambda folder: p.select(F.concat_ws("/", F.lit("/root"), folder, "image").alias("path"))
    return sources.image_index(at(F.coalesce("source", F.lit("none"))).unionByName(at(F.lit("zz"))), "/root", last_wins=True)


@query(f"WITH {FIXTURE} SELECT type, count(*) AS n, round(avg(length(text)), 6) AS chars FROM gt GROUP BY type")
def report_file(spark, sf_dir):
    """A nested report as one JSON text, and its table read back from it."""
    folder = fresh_folder(spark, "report")
    r = fx.solution(spark, sf_dir).select(F.explode("regions").alias("r"))
    types = r.groupBy("r.type").agg(F.count("*").alias("n"), F.avg(F.length("r.text")).alias("chars"))
    sinks.write_report(spark, {"types": types, "made_of": {"table": "documents"}}, folder)
    whole = spark.read.text(f"{folder}/json", wholetext=True)
    read = whole.select(F.explode(F.from_json("value", "types array<struct<type:string,n:long,chars:double>>")["types"]).alias("t")).select("t.*")
    return read.withColumn("chars", F.round("chars", 6))


@query(f"""WITH {FIXTURE} SELECT image, CASE WHEN d % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS seq, count(*) AS n FROM gt WHERE d % 2 = 0 OR d % 3 = 0 GROUP BY image, d""")
def resumed_log(spark, sf_dir):
    """Pages done after two runs of a log: the second goes on from the first's checkpoint and records some pages again."""
    folder = fresh_folder(spark, "log")
    p = fx.pages(spark, sf_dir)
    for seq, every in ((1, 2), (2, 3)):
        done = p.where(F.col("doc_id") % every == 0).select(
            F.lit(seq).cast("long").alias("seq"), "image", "source", F.col("regions").cast(REGIONS).alias("regions"), F.lit(0.25).alias("conf"), F.lit(0.5).alias("iou")
        )
        progress.append(done, f"{folder}/log")
        progress.upsert(spark, f"{folder}/log", f"{folder}/state", f"{folder}/checkpoint")
    state = progress.read_state(spark, f"{folder}/state")
    if state is None:
        state = spark.createDataFrame([], progress.RECORD)
    kept = progress.completed(p.select("image"), state)
    return state.join(kept, "image", "left_semi").select("image", "seq", F.size("regions").cast("long").alias("n"))


@query(f"""WITH {FIXTURE} SELECT type, count(*) AS n, count(*) AS names FROM gt
    WHERE language = 'uk' AND legibility = 'legible' AND type NOT IN ('image', 'graph') AND length(trim(text)) > 0 GROUP BY type""")
def crops_of_lines(spark, sf_dir):
    """Training crops of pages read as lines, by type; their running names differ throughout."""
    folder = fresh_folder(spark, "crops")
    sinks.write_jsonl(_page_rows(spark, sf_dir), folder)
    pages = sources.read_crop_pages(spark, folder)
    paths = fx.solution(spark, sf_dir).select(F.concat_ws("/", F.lit("/root"), F.coalesce("source", F.lit("none")), "image").alias("path"))
    found = sources.crops_from_lines(pages, sources.image_index(paths, "/root", last_wins=True), "gold")
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("image_path").alias("names"))


#: The limit of silver crops; the page that reaches it is taken whole.
SILVER = 5000


@query(f"""WITH {FIXTURE}, c AS (SELECT image, any_value(source) AS source, any_value(d) AS d, count(*) AS n, sum(length(text))::BIGINT AS chars FROM gt
      WHERE language = 'uk' AND type NOT IN ('image', 'graph') GROUP BY image),
    o AS (SELECT *, sum(n) OVER (ORDER BY d * 10000 + regexp_extract(image, '_([0-9]+)[.]jpg$', 1)::BIGINT) - n AS ahead FROM c)
    SELECT '/root/' || coalesce(source, 'none') || '/' || image AS source_image, n, chars FROM o WHERE ahead < {SILVER}""")
def silver_lines(spark, sf_dir):
    """Crops to be read anew, of the first pages by document and place, as far as the limit goes."""
    folder = fresh_folder(spark, "silver")
    sinks.write_jsonl(_page_rows(spark, sf_dir), folder)
    part = lambda k: F.regexp_extract("image", r"^doc_(\d+)_(\d+)\.jpg$", k).cast("long")
    pages = sources.read_crop_pages(spark, folder).withColumn("page_no", part(1) * 10_000 + part(2))
    paths = fx.solution(spark, sf_dir).select(F.concat_ws("/", F.lit("/root"), F.coalesce("source", F.lit("none")), "image").alias("path"))
    found = sources.silver_crops_from_lines(pages, sources.image_index(paths, "/root", last_wins=True), SILVER)
    return found.groupBy("source_image").agg(F.count("*").alias("n"), F.sum(F.length("silver_text")).alias("chars"))


@query(f"""WITH {FIXTURE} SELECT type, count(*) AS n, (0.5 * count(*) FILTER (WHERE gi % 2 = 1))::DOUBLE AS weight, count(*) FILTER (WHERE gi % 2 = 0) AS earlier FROM gt GROUP BY type""")
def manifests_joined(spark, sf_dir):
    """A written manifest that lacks weights and new rows that have them, as one written manifest."""
    folder = fresh_folder(spark, "manifests")
    rows = fx.solution(spark, sf_dir).select("image", F.posexplode("regions").alias("gi", "r"))
    rows = rows.select(F.concat("image", F.lit("#"), F.col("gi").cast("string")).alias("image_path"), "gi", "r.type", "r.text")
    old = rows.where("gi % 2 = 0").select("image_path", "text", "type", F.lit("old").alias("made"))
    new = rows.where("gi % 2 = 1").select("type", "text", "image_path", F.lit(0.5).alias("weight"))
    sinks.write_manifest(sources.with_earlier(spark, old, f"{folder}/none"), f"{folder}/old")
    sinks.write_manifest(sources.with_earlier(spark, new, f"{folder}/old"), f"{folder}/both")
    read = sources.read_manifest(spark, f"{folder}/both", defaults={"weight": 0.0})
    return read.groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.count("made").alias("earlier"))
