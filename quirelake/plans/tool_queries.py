"""Queries over the readers, curation and viewer operators, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import compare, curation, pages, postprocess
from ..sources import regions as sources
from ..sources import sinks
from ..streaming import progress
from . import fixtures as fx
from .fixtures import SQL as FIXTURE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PAGES = "(SELECT DISTINCT image, source, d FROM gt)"


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.submission(spark, sf_dir).select("image", F.posexplode("regions").alias("pi", "r"))


_BARE = r"""trim(regexp_replace(regexp_replace(lower(t), '\s+', ' ', 'g'), '[.,;:!?"''`ʼ’‘“”„«»()\[\]{}]', '', 'g'))"""


@query(rf"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_id, t, {_BARE} AS plain FROM x)
    SELECT doc_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS sanitized, md5(plain) AS plain, md5(regexp_replace(plain, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS compact, md5(plain) AS plain_v2 FROM k""")
def text_keys(spark, sf_dir):
    """Sanitised texts and the keys that duplicates are judged by."""
    t = F.col("text")
    keys = {"sanitized": X.sanitize(t), "plain": X.plain_key(t), "compact": X.compact(t), "plain_v2": X.plain_key_v2(t)}
    return fx.table(spark, sf_dir, "documents").select("doc_id", *[F.md5(k).alias(n) for n, k in keys.items()])


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\S+')) AS w FROM documents)
    SELECT regexp_replace(lower(w), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS key, count(*) AS n FROM w GROUP BY 1""")
def token_keys(spark, sf_dir):
    w = fx.table(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("w"))
    return w.groupBy(X.token_key(F.col("w")).alias("key")).agg(F.count("*").alias("n"))


_WORDS = r"regexp_extract_all(trim(text), '\S+')"
_SURE = rf"""(regexp_matches(text, '[A-Za-z0-9]') AND (len({_WORDS}) < 4 OR len(list_distinct({_WORDS})) / len({_WORDS})::DOUBLE >= 0.4)
    AND (length(trim(text)) <= 5 OR length(regexp_replace(trim(text), '[A-Za-z0-9 .,!?;:''\-()\[\]]', '', 'g')) / length(trim(text))::DOUBLE <= 0.5))"""


@query(rf"""WITH {FIXTURE}, x AS (SELECT *, {_SURE} AS sure FROM pr)
    SELECT type, count(*) FILTER (WHERE NOT sure AND conf > 0.5) AS taken, count(*) AS n FROM x GROUP BY type""")
def ensemble_choice(spark, sf_dir):
    """How often another reader's text is taken: where one's own isn't confident and the other has confidence."""
    r = _regions(spark, sf_dir).select("r.type", "r.text", "r.conf")
    other = F.lit("a confident other text")
    return r.groupBy("type").agg(F.count_if(X.choose_text(F.col("text"), other, F.col("conf")) == other).alias("taken"), F.count("*").alias("n"))


@query(rf"""WITH {FIXTURE}, p AS (SELECT image, '/root/' || source || '/' || image AS path FROM {_PAGES})
    SELECT image AS name, path, path AS by_stem FROM p UNION ALL SELECT 'elsewhere/' || image, path, path FROM p
    UNION ALL SELECT 'doc_' || doc_id || '_none.jpg', NULL, NULL FROM documents""")
def image_lookup(spark, sf_dir):
    """Images found under a root by whole name, base name or stem."""
    have = fx.solution(spark, sf_dir).select("image", F.concat_ws("/", F.lit("/root"), "source", "image").alias("path"))
    index = sources.image_index(have.select("path"), "/root")
    lack = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_none.jpg")).alias("name"))
    names = have.select(F.col("image").alias("name")).union(have.select(F.concat(F.lit("elsewhere/"), "image"))).union(lack)
    by_stem = sources.resolve_images(names, index, sources.BASE_FIRST).select("name", F.col("path").alias("by_stem"))
    return sources.resolve_images(names, index).join(by_stem, "name")


@query(f"""WITH {FIXTURE}, x AS (SELECT DISTINCT image, d, source FROM gt)
    SELECT image || '.png' AS image, 100 + d % 7 AS width, 200::BIGINT AS height, CASE WHEN d % 3 = 0 THEN 'unknown' ELSE source END AS source FROM x""")
def page_sizes(spark, sf_dir):
    p = fx.pages(spark, sf_dir).select(
        F.concat(F.lit("a/b/"), "image", F.lit(".png")).alias("file_name"), (100 + F.col("doc_id") % 7).alias("image_width"),
        F.lit(200).cast("long").alias("image_height"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source")
    )
    return sources.page_sizes(p)


@query(f"""WITH {FIXTURE} SELECT image, row_number() OVER (PARTITION BY image ORDER BY conf DESC, x1, y1, x2, y2, type) - 1 AS place, x1::BIGINT AS x1, y1::BIGINT AS y1, type, conf::DOUBLE AS conf
    FROM (SELECT DISTINCT image, x1, y1, x2, y2, type, conf FROM pr WHERE conf >= 0.7)""")
def detections(spark, sf_dir):
    """Detector rows made into regions: by falling confidence, texts empty."""
    from ..schema import REGION_TYPES

    number = F.create_map(*[F.lit(x) for i, t in enumerate(REGION_TYPES) for x in (t, i)])
    r = _regions(spark, sf_dir)
    rows = r.select(
        "image", *[F.col("r.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], number[F.col("r.type")].alias("class"), "r.conf"
    ).distinct()
    got = sources.detections_to_regions(rows, 0.7).select("image", F.posexplode("regions").alias("place", "r"))
    return got.select(
        "image", F.col("place").cast("long").alias("place"), F.col("r.bbox")[0].cast("long").alias("x1"), F.col("r.bbox")[1].cast("long").alias("y1"),
        "r.type", "r.conf"
    )


def _odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [
        "[]", '{"bbox": 1}', "not JSON [", '[{"bbox": [1, 2, 3, 4], "text": "a"}, {"bbox": ["5", 6, 7, 8], "type": "table"}]',
        '[7, {"type": "table"}, {"bbox": [1, 2]}]', '[{"bbox": [1, 2, 3, 4], "type": "odd"}]'
    ]
    regions = F.element_at(F.array(*[F.lit(t) for t in [*texts, None]]), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    return fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image"), regions.alias("regions"))


@query("""SELECT doc_id::VARCHAR AS image, CASE doc_id % 7 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END::BIGINT AS n FROM documents""")
def lenient_regions(spark, sf_dir):
    """Regions read out of texts of all kinds: anything but a list gives none, and of a list only the objects count."""
    return _odd_rows(spark, sf_dir).select("image", F.size(sources.parse_lenient(F.col("regions"))).cast("long").alias("n"))


@query("""SELECT doc_id::VARCHAR AS image, -1::BIGINT AS i, 'regions must be a JSON list' AS error FROM documents WHERE doc_id % 7 = 1 UNION ALL SELECT doc_id::VARCHAR, -1, 'invalid JSON' FROM documents WHERE doc_id % 7 = 2
    UNION ALL SELECT doc_id::VARCHAR, unnest([0, 1, 2]), unnest(['must be a JSON object', 'missing "bbox" field', 'bbox must be [x1, y1, x2, y2]']) FROM documents WHERE doc_id % 7 = 4
    UNION ALL SELECT doc_id::VARCHAR, 0, 'invalid type' FROM documents WHERE doc_id % 7 = 5""")
def region_errors(spark, sf_dir):
    """What strict reading says about texts of all kinds; -1 where the whole text is wrong."""
    return sources.region_errors(_odd_rows(spark, sf_dir)).withColumn("i", F.coalesce("i", F.lit(-1)).cast("long"))


@query(f"WITH {FIXTURE} SELECT type, count(*) AS n FROM gt GROUP BY type")
def type_histogram(spark, sf_dir):
    p = fx.solution(spark, sf_dir)
    none = F.lit(None).cast(p.schema["regions"].dataType)
    return curation.type_histogram(p.select(none.alias("regions"), F.col("regions").alias("annotations"), none.alias("labels")))


@query(
    f"WITH {FIXTURE} SELECT source, count(*) AS n FROM {_PAGES} WHERE source IN ('src0', 'src1', (SELECT min(source) FROM documents)) GROUP BY source"
)
def pages_of_sources(spark, sf_dir):
    least = fx.table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    return curation.of_sources(fx.solution(spark, sf_dir), ["src0", "src1", least]).groupBy("source").agg(F.count("*").alias("n"))


@query(
    f"WITH {FIXTURE}, x AS (SELECT *, 3 + gi % 20 AS w, 2 + gi % 9 AS h FROM gt) SELECT type, count(*) AS n FROM x WHERE length(trim(text)) BETWEEN 2 AND 80 AND w >= 10 AND h >= 5 GROUP BY type"
)
def external_quality(spark, sf_dir):
    r = fx.solution(spark, sf_dir).select(F.posexplode("regions").alias("i", "r"))
    rows = r.select("r.type", "r.text", (3 + F.col("i") % 20).alias("width"), (2 + F.col("i") % 9).alias("height"))
    return curation.external_quality(rows).groupBy("type").agg(F.count("*").alias("n"))


@query(rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT 'doc_' || doc_id AS image, length(t) AS length, left(t, 160) AS text_head FROM docs WHERE length(t) >= 180)
    SELECT *, 'handwritten' AS type FROM x ORDER BY length DESC, image DESC, text_head DESC LIMIT 25""")
def long_examples(spark, sf_dir):
    """The longest texts: a top list."""
    one = F.struct(F.lit("handwritten").alias("type"), F.col("text"))
    docs = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("image"), F.array(one).alias("regions")
    )
    return postprocess.long_examples(docs, 25).withColumn("length", F.col("length").cast("long"))


_INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))::DOUBLE"
_MUCH = f"{_INTER} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER}) >= 0.8"


@query(f"WITH {FIXTURE} SELECT count(*) AS overlap_pairs FROM pr a JOIN pr b ON a.image = b.image AND a.pi < b.pi AND {_MUCH}")
def overlap_count(spark, sf_dir):
    return pages.overlap_count(fx.submission(spark, sf_dir))


@query(f"""WITH {FIXTURE}, h AS (SELECT 20 + (d % 12) * 30 AS height, 100 + (gi % 9) * 400 AS width FROM gt)
    SELECT height, width, CASE WHEN height <= 128 THEN width ELSE greatest(32, least(1920, round_even(width * 128 / height::DOUBLE, 0)))::BIGINT END AS new_width, least(height, 128) AS new_height, count(*) AS n FROM h GROUP BY ALL""")
def resized_crops(spark, sf_dir):
    r = fx.pages(spark, sf_dir).select("doc_id", F.posexplode("regions").alias("gi", "r")).select(
        (20 + F.col("doc_id") % 12 * 30).alias("height"), (100 + F.col("gi") % 9 * 400).cast("long").alias("width")
    )
    new = G.resized(F.col("width"), F.col("height"))
    return r.groupBy(
        "height", "width", new["width"].cast("long").alias("new_width"), new["height"].cast("long").alias("new_height")
    ).agg(F.count("*").alias("n"))


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = fx.pages(spark, sf_dir)
    got, raw = p.select("image", F.col("pred").alias("regions")), p.select("image", "regions")
    return compare.annotate(got, raw), compare.removed(got, raw)


_KEY = "x1 || ',' || y1 || ',' || x2 || ',' || y2 || '|' || type"


@query(
    f"""WITH {FIXTURE}, k AS (SELECT DISTINCT image, {_KEY} AS key FROM pr) SELECT (SELECT count(*) FROM pr) AS regions, (SELECT count(*) FROM gt LEFT JOIN k ON k.image = gt.image AND k.key = {_KEY.replace('x1', 'gt.x1').replace('|| type', '|| gt.type')} WHERE k.key IS NULL) AS removed"""
)
def candidate_totals(spark, sf_dir):
    return compare.candidate_totals(*_annotated(spark, sf_dir)).select("regions", "removed")


@query(f"""WITH {FIXTURE}, f AS (SELECT DISTINCT a.image FROM pr a JOIN pr b ON a.image = b.image AND a.pi <> b.pi AND {_MUCH} UNION SELECT image FROM pr WHERE length(text) >= 180)
    SELECT p.image FROM {_PAGES} p WHERE p.source = (SELECT min(source) FROM documents) AND p.image IN (SELECT image FROM f) AND p.image IN (SELECT image FROM pr WHERE contains(lower(text), 'the') OR contains(type, 'the'))""")
def viewer_filter(spark, sf_dir):
    """Pages of one source that have flags and hold a word."""
    least = fx.table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    found, _ = _annotated(spark, sf_dir)
    # loops and runs of characters, whose flags the other viewer query has, are left out
    flags = F.filter("flags", lambda x: x.isin("overlap_iou80", "long_text"))
    rows = found.withColumn("flags", flags).groupBy("image").agg(F.collect_list(F.struct("type", "text", "flags")).alias("regions"))
    rows = rows.join(fx.solution(spark, sf_dir).select("image", "source"), "image")
    return compare.filter_pages(rows, least, True, "The").select("image")


@query(f"""WITH {FIXTURE}, c AS (SELECT image, row_number() OVER (ORDER BY image) AS r, count(*) OVER () AS have FROM {_PAGES})
    SELECT image, 2500 // have + (r <= 2500 % have)::BIGINT AS n FROM c WHERE 2500 // have + (r <= 2500 % have)::BIGINT > 0""")
def repeated_pages(spark, sf_dir):
    """Pages repeated in turn until there are 2,500."""
    return curation.repeat_to(fx.solution(spark, sf_dir).select("image"), 2500, "image").groupBy("image").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT doc_id, sum(round(doc_id % 5 * 1000000))::BIGINT AS u, any_value(md5('42|' || doc_id)) AS h FROM documents GROUP BY doc_id),
    line AS (SELECT *, sum(u) OVER (ORDER BY h, doc_id::VARCHAR) AS hi, sum(u) OVER () AS total FROM k WHERE u > 0),
    points AS (SELECT ('0x' || substr(md5('42|draw|' || i), 1, 15))::BIGINT % (SELECT max(total) FROM line) AS p FROM range(3000) AS r(i))
    SELECT doc_id, doc_id % 5 AS weight, count(*) AS draws FROM points JOIN line ON p >= hi - u AND p < hi GROUP BY doc_id""")
def weighted_sample(spark, sf_dir):
    """Exactly 3,000 draws by weight, with replacement: the documents drawn and how often."""
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).cast("double").alias("sample_weight"))
    return curation.weighted_sample(rows, 3000, "doc_id").select("doc_id", F.col("sample_weight").cast("long").alias("weight"), "draws")


def _read(kind: str, frame) -> list[str]:
    if len(frame) > 500:
        raise MemoryError
    return [f"{kind}:{t.upper()}" for t in frame["text"]]


@query(f"WITH {FIXTURE} SELECT image, gi::BIGINT AS idx, type, type || ':' || upper(text) AS text FROM gt")
def model_texts(spark, sf_dir):
    """A model's texts for crops, by type, in batches that are halved where they are too large."""
    r = fx.solution(spark, sf_dir).select("image", F.posexplode("regions").alias("idx", "r")).select(
        "image", F.col("idx").cast("long").alias("idx"), "r.type", "r.text"
    )
    return curation.run_model(r, _read)


@query(f"""WITH {FIXTURE}, s AS (SELECT DISTINCT image, d FROM gt) SELECT s.image, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT image, count(*) AS n FROM pr GROUP BY 1) USING (image) WHERE d % 2 = 0
    UNION ALL SELECT image, 0 FROM s WHERE d % 2 = 1""")
def partial_output(spark, sf_dir):
    """A whole submission while only even documents are done."""
    p = fx.pages(spark, sf_dir)
    done = p.where("doc_id % 2 = 0").select("image", F.col("pred").alias("regions"))
    return progress.partial_output(p.select("image", "doc_id"), done, "doc_id").select("image", F.size("regions").cast("long").alias("n"))


@query(f"""WITH {FIXTURE} SELECT image, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM gt GROUP BY ALL""")
def solution_pages(spark, sf_dir):
    """The validation solution, its regions as JSON text and read back."""
    p = fx.solution(spark, sf_dir).select(
        "image", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("string").alias("id"), "source", "regions",
        F.lit(None).cast(fx.solution(spark, sf_dir).schema["regions"].dataType).alias("annotations")
    )
    rows = curation.valid_solution(p).withColumn("regions", F.to_json("regions"))
    read = sources.parse_strict(rows, submission=False)
    return read.select(
        "image", "source", F.size("regions").cast("long").alias("n"),
        F.aggregate("regions", F.lit(0), lambda a, r: a + F.length(r["text"])).cast("long").alias("chars")
    )


@query(
    f"""WITH {FIXTURE}, x AS (SELECT image, string_agg(pi || ':' || type, ',' ORDER BY pi) AS t, count(*) AS n FROM pr GROUP BY image) SELECT image, n, t AS types FROM x"""
)
def viewer_pages(spark, sf_dir):
    """Each page's annotated regions as one JSON text, and read back."""
    found, _ = _annotated(spark, sf_dir)
    read = sinks.viewer_json(found).select("image", F.from_json("json", "array<struct<id:int,type:string>>").alias("r"))
    return read.select(
        "image", F.size("r").cast("long").alias("n"),
        F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["id"].cast("string"), x["type"])), ",").alias("types")
    )
