"""Readers of pages, submissions, manifests and labels, and the strict and lenient region parsers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regions import pseudo_usable, train_usable
from ..functions.text import normalize_target, strip
from ..operators.pages import held
from ..schema import NON_SCORABLE, PAGE, REGION_TYPES, REGIONS
from .shared import kept

_LOOSE = "array<struct<bbox:array<string>,type:string,text:string,language:string,legibility:string,conf:double>>"


class InvalidRegions(ValueError):
    """A submission or solution that breaks the format, with image and position."""


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)


def read_pages(spark: SparkSession, path: str, strict: bool = False, may_miss: bool | None = None) -> DataFrame:
    """JSON Lines of pages. Lenient: malformed lines are left out. Strict: they raise.

    may_miss: whether a missing path is an empty table, or raises; if not given, it is one for lenient reading only.
    """
    may_miss = not strict if may_miss is None else may_miss
    try:
        if strict:
            return spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)
        rows = spark.read.schema(
            T.StructType([*PAGE.fields, T.StructField("_bad", T.StringType())])
        ).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if may_miss and _missing(e):
            return spark.createDataFrame([], PAGE)
        raise
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def first_text(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def first_list(*names: str) -> Column:
    return F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names], F.array().cast(REGIONS))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def read_region_csv(spark: SparkSession, path: str) -> DataFrame:
    """image, regions (JSON text)."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(
        "image string, regions string"
    ).csv(path)


def _typed(loose: Column) -> Column:
    def one(r: Column) -> Column:
        return F.struct(
            F.transform(r["bbox"], lambda v: v.try_cast("double")).alias("bbox"),
            F.coalesce(r["type"], F.lit("handwritten")).alias("type"),
            F.coalesce(r["text"], F.lit("")).alias("text"),
            F.coalesce(r["language"], F.lit("uk")).alias("language"),
            F.coalesce(r["legibility"], F.lit("legible")).alias("legibility"),
            r["conf"].alias("conf"),
        )

    return F.transform(loose, one)


def parse_lenient(c: Column) -> Column:
    """Regions of a JSON text; anything but a list gives none. Elements of a list that aren't objects are left out."""
    parsed = F.try_parse_json(c)
    objects = F.filter(parsed.cast("array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    one_by_one = F.transform(objects, lambda v: F.from_json(F.to_json(v), _LOOSE[6:-1]))  # where an odd element spoils the list
    read = F.coalesce(F.from_json(c, _LOOSE), one_by_one)
    return F.when(
        F.schema_of_variant(parsed).startswith("ARRAY"), F.coalesce(_typed(read), F.array().cast(REGIONS))
    ).otherwise(F.array().cast(REGIONS))


def violations(regions: Column, submission: bool = True) -> Column:
    """i and error of every violation in a JSON text of regions. ``i`` is null where the whole text is wrong; null and empty texts have none."""

    def error(r: Column) -> Column:
        kind = F.schema_of_variant(r)
        box, said = F.try_variant_get(r, "$.bbox", "array<variant>"), F.try_variant_get(r, "$.type", "string")
        has = lambda name: F.array_contains(F.json_object_keys(F.to_json(r)), name)
        known = F.coalesce(said.isin(*REGION_TYPES), F.lit(False))
        boxed = F.coalesce(F.size(box) == 4, F.lit(False))
        # a region with its box and a known type is right, whatever else it has
        found = F.when(boxed & known, None) if submission else F.when(boxed, None)
        found = found.when(kind.isNull() | ~kind.startswith("OBJECT"), "must be a JSON object")
        found = found.when(~has("bbox"), 'missing "bbox" field').when(~boxed, "bbox must be [x1, y1, x2, y2]")
        return found.when(has("type") & ~known, "invalid type") if submission else found

    def of(v: Column) -> Column:
        whole = lambda text: F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(text).alias("error")))
        items = F.transform(v.cast("array<variant>"), lambda r, i: F.struct(i.alias("i"), error(r).alias("error")))
        return F.when(v.isNull(), whole("invalid JSON")).when(
            ~regions.rlike(r"^[ \t\n\r]*\["), whole("regions must be a JSON list")  # of a valid text the first sign tells
        ).otherwise(F.filter(items, lambda x: x["error"].isNotNull()))

    # the parsed text is bound by a lambda, so that it is parsed once
    read = F.get(F.transform(F.array(F.try_parse_json(regions)), of), F.lit(0))
    return F.when(regions.isNull() | (regions == ""), F.array().cast("array<struct<i:int,error:string>>")).otherwise(read)


def region_errors(rows: DataFrame, submission: bool = True) -> DataFrame:
    """(image, i, error) of every violation in ``rows`` (image, regions as JSON text). ``i`` is null where the whole text is wrong."""
    return rows.select("image", F.explode(violations(F.col("regions"), submission)).alias("e")).select("image", "e.i", "e.error")


def parse_strict(rows: DataFrame, submission: bool = True) -> DataFrame:
    """(image, regions) with typed regions; raises InvalidRegions naming up to five violations.

    Rows are read, checked and written to the shared folder in one pass; what is checked and returned is read from there.
    """
    empty = F.col("regions").isNull() | (F.col("regions") == "")
    typed = F.when(empty, F.array().cast(REGIONS)).otherwise(_typed(F.from_json("regions", _LOOSE)))
    read = kept(rows.select("*", typed.alias("__typed"), violations(F.col("regions"), submission).alias("__errors")).drop("regions"), "parsed")
    wrong = read.select("image", F.explode("__errors").alias("e")).select("image", "e.i", "e.error")
    if found := wrong.orderBy("image", "i").limit(5).collect():
        raise InvalidRegions(
            "; ".join(f'image "{r["image"]}"' + (f', region {r["i"]}' if r["i"] is not None else "") + f': {r["error"]}' for r in found)
        )
    return read.select(*[F.col("__typed").alias(c) if c == "regions" else c for c in rows.columns])


def page_sizes(pages: DataFrame) -> DataFrame:
    """image (base name), width, height, source of test pages."""
    return pages.select(
        basename(F.col("file_name")).alias("image"), F.col("image_width").alias("width"), F.col("image_height").alias("height"),
        F.coalesce("source", F.lit("unknown")).alias("source")
    )


def image_index(paths: DataFrame, root: str, last_wins: bool = False) -> DataFrame:
    """key, path for the names that each file under ``root`` goes by. ``paths`` has path. The first (or last) path by name keeps a key."""
    rel = F.regexp_replace("path", f"^(?:file:)?{root.rstrip('/')}/", "")
    keys = F.array(basename(F.col("path")), stem(F.col("path"))) if last_wins else F.array(
        basename(F.col("path")), stem(F.col("path")), rel, F.concat(F.lit("images/"), basename(F.col("path")))
    )
    pick = F.max if last_wins else F.min
    return paths.select("path", F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(pick("path").alias("path"))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


#: Orders in which consumers look an image up: the whole name, its base name, its stem.
WHOLE_FIRST, WHOLE_OR_STEM, BASE_FIRST = ("whole", "base", "stem"), ("whole", "stem"), ("base", "stem")


def resolve_images(names: DataFrame, index: DataFrame, order: tuple[str, ...] = WHOLE_FIRST) -> DataFrame:
    """name and path: looked up by each of the ways in ``order``; null where none finds one."""
    ways = {"whole": F.col("name"), "base": basename(F.col("name")), "stem": stem(F.col("name"))}
    keys = F.array(*[ways[w] for w in order])
    tried = names.select(
        "name", F.posexplode(keys).alias("rank", "key")
    ).join(index, "key").groupBy("name").agg(F.min_by("path", "rank").alias("path"))
    return names.join(tried, "name", "left")


def cap_by_page(crops: DataFrame, most: int, order: str = "page_no") -> DataFrame:
    """Crops of the pages before which fewer than ``most`` crops stand: the limit is tested per page, so it can be passed by one page's crops.

    Running counts come from per-page totals, summed by blocks of pages first, so no single task sees all pages' rows.
    """
    return crops.join(_ahead(crops, order).where(F.col("ahead") < most).select(order), order, "left_semi")


def _ahead(crops: DataFrame, order: str, n: Column | None = None) -> DataFrame:
    """Each page number and how many crops stand before its page; ``n`` are the crops of a row, if not one."""
    pages = crops.groupBy(order).agg((F.count("*") if n is None else F.sum(n)).alias("n")).withColumn("block", F.floor(F.col(order) / 10_000))
    blocks = pages.groupBy("block").agg(F.sum("n").alias("bn"))
    before_block = blocks.withColumn(
        "before", F.coalesce(F.sum("bn").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.join(before_block, "block").select(order, (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("ahead"))


_CROP_REGION = "array<struct<bbox:array<double>,bbox_2d:array<double>,type:string,text:string,language:string,legibility:string>>"


def read_crop_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of pages for cropping, with ``page_no`` in the order of lines; regions may name their box bbox_2d. Malformed lines are left out; a missing path is empty."""
    schema = f"image string, file_name string, filename string, id string, regions {_CROP_REGION}, annotations {_CROP_REGION}"
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if _missing(e):
            return spark.createDataFrame([], f"{schema}, page_no long")
        raise
    # held, so that no filter on what a line has reads the line again
    rows = held(lines.where(F.trim("value") != "").select(
        F.monotonically_increasing_id().alias("page_no"),
        F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")
    ))
    return rows.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("r.*", "page_no").drop("_bad")


def _named(pages: DataFrame) -> DataFrame:
    """page_no, name and regions of those pages of ``read_crop_pages`` that have a name."""
    return pages.select(
        "page_no", first_text("image", "file_name", "filename", "id").alias("name"), _first_boxes("regions", "annotations").alias("regions")
    ).where("name IS NOT NULL")


def _located(named: DataFrame, index: DataFrame) -> DataFrame:
    """page_no and source_image of pages whose image ``index`` has, by whole name or stem."""
    keys = F.array(F.col("name"), stem(F.col("name")))
    tried = named.select("page_no", F.posexplode(keys).alias("rank", "key")).join(index, "key")
    return tried.groupBy("page_no").agg(F.min_by("path", "rank").alias("source_image"))


def _crop_box(r: Column) -> Column:
    return F.coalesce(F.when(F.size(r["bbox"]) > 0, r["bbox"]), F.when(F.size(r["bbox_2d"]) > 0, r["bbox_2d"]))


def _usable(r: Column) -> Column:
    kind = F.coalesce(r["type"], F.lit("handwritten"))
    return (F.coalesce(r["language"], F.lit("uk")) == "uk") & ~kind.isin(*NON_SCORABLE) & _crop_box(r).isNotNull()


def _usable_regions(pages: DataFrame) -> DataFrame:
    """Boxed and undrawn Ukrainian regions of named pages with source_image.

    Columns: page_no, name, source_image, i, bbox, type, text (stripped) and legibility.
    """
    r = F.col("r")
    rows = pages.select("page_no", "name", "source_image", F.posexplode("regions").alias("i", "r")).where(_usable(r))
    return rows.select(
        "page_no", "name", "source_image", "i", _crop_box(r).alias("bbox"), F.coalesce(r["type"], F.lit("handwritten")).alias("type"),
        strip(F.coalesce(r["text"], F.lit(""))).alias("text"), F.coalesce(r["legibility"], F.lit("legible")).alias("legibility")
    )


def _found_regions(pages: DataFrame, index: DataFrame) -> DataFrame:
    """The usable regions of pages of ``read_crop_pages`` whose image ``index`` has."""
    named = _named(pages)
    return _usable_regions(named.join(_located(named, index), "page_no"))


def crops_from_lines(pages: DataFrame, index: DataFrame, split: str, weight: float = 1.0, most: int | None = None) -> DataFrame:
    """Training crops of ``read_crop_pages``: image_path, source_image, bbox, text (as a target), weight, source and type.

    Only pages whose image ``index`` (key, path) finds count, by whole name or stem. Names number the crops through the whole file. With
    ``most`` a page is left out once that many crops stand before it, so the limit can be passed by one page's crops.
    """
    rows = _found_regions(pages, index).where("text <> '' AND legibility <> 'illegible'")
    if most is not None:
        rows = cap_by_page(rows, most)
    rows = rows.join(_ahead(rows, "page_no"), "page_no")
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("page_no").orderBy("i")) - 1
    path = F.concat(stem(F.col("name")), F.format_string("_r%06d.jpg", place))
    return rows.select(
        path.alias("image_path"), "source_image", "bbox", normalize_target(F.col("text"), F.col("type")).alias("text"), F.lit(weight).alias("weight"),
        F.lit(split).alias("source"), "type"
    )


def silver_crops_from_lines(pages: DataFrame, index: DataFrame, most: int | None = None) -> DataFrame:
    """Crops to be read anew: source_image, bbox, type and silver_text, what the page has for it, which may be empty or illegible.

    Pages, and the limit ``most``, are taken as by ``crops_from_lines``; page numbers may be any that order the pages.
    """
    if most is None:
        rows = _found_regions(pages, index)
    else:
        # lines are read once to count each page's crops and once for the pages taken; in between there are only numbers, names and counts
        named = _named(pages)
        counts = kept(named.select("page_no", "name", F.size(F.filter("regions", _usable)).alias("n")).where("n > 0"), "counts")
        found = kept(counts.groupBy("page_no").agg(F.sum("n").alias("n")).join(_located(counts, index), "page_no"), "found")
        first = found.join(_ahead(found, "page_no", F.col("n")).where(F.col("ahead") < most), "page_no").select("page_no", "source_image")
        # each page that is taken has a crop, so there are at most as many as the limit
        rows = _usable_regions(named.join(F.broadcast(first), "page_no"))
    return rows.select("source_image", "bbox", "type", F.col("text").alias("silver_text"))


def _first_boxes(*names: str) -> Column:
    return F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names], F.array().cast(_CROP_REGION))


def crops(pages: DataFrame, split: str, weight: float, usable=train_usable) -> DataFrame:
    """A row for each usable region: image, page position, source, type, text, bbox, weight and a running crop name."""
    named = pages.select(
        first_text("image", "file_name", "filename", "id").alias("image"), F.coalesce("source", F.lit("unknown")).alias("source"),
        first_list("regions", "annotations", "labels").alias("regions")
    )
    rows = named.select("image", "source", F.posexplode("regions").alias("idx", "r")).where(usable(F.col("r")))
    rank = F.row_number().over(Window.partitionBy("image").orderBy("idx")) - 1
    name = F.concat(F.lit(f"{split}/"), stem(F.col("image")), F.format_string("_r%06d.jpg", rank))
    return rows.select(
        "image", "source", "idx", "r.bbox", "r.type", F.col("r.text").alias("text"), name.alias("image_path"), F.lit(weight).alias("weight")
    )


def silver_crops(pages: DataFrame, weight: float = 0.5) -> DataFrame:
    return crops(pages, "silver", weight, pseudo_usable)


def read_external_labels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """image, text from a JSON map, a CSV whose columns go by various names, or image-side text files."""
    if kind == "map":
        text = spark.read.text(path, wholetext=True)
        return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("image", "text"))
    if kind == "csv":
        raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
        names = {
            c: "image" if c.lower() in ("image", "filename", "file", "path") else "text" if c.lower() in (
                "text", "label", "transcript", "transcription"
            ) else c for c in raw.columns
        }
        return raw.withColumnsRenamed(names).select("image", "text")
    text = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return text.select(stem(F.input_file_name()).alias("image"), F.col("value").alias("text"))


def first_external_labels(spark: SparkSession, candidates: list[tuple[str, str]]) -> DataFrame:
    """Labels from the first of (path, kind) that exists; an empty table if none does."""
    for path, kind in candidates:
        try:
            return read_external_labels(spark, path, kind)
        except AnalysisException as e:
            if not _missing(e):
                raise
    return spark.createDataFrame([], "image string, text string")


def read_word_list(spark: SparkSession, paths: list[str], least: int = 2) -> DataFrame:
    """Trimmed words of the first path that exists."""
    for path in paths:
        try:
            return spark.read.text(path).select(F.trim("value").alias("word")).where(F.length("word") >= least)
        except AnalysisException as e:
            if not _missing(e):
                raise
    return spark.createDataFrame([], "word string")


def label_file_counts(spark: SparkSession, path: str) -> DataFrame:
    """class and n over detector label files."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.split(F.trim("value"), r"\s+")[0].cast("int").alias("class")
    ).groupBy("class").agg(F.count("*").alias("n"))


def row_count(spark: SparkSession, path: str) -> int:
    """Non-blank lines of a file; 0 where it is missing."""
    try:
        return spark.read.text(path).where(F.trim("value") != "").count()
    except AnalysisException as e:
        if _missing(e):
            return 0
        raise


def read_manifest(
    spark: SparkSession, path: str, most: int | None = None, order: str = "image_path", defaults: dict[str, object] | None = None
) -> DataFrame:
    """A CSV manifest, its first ``most`` rows by ``order`` if a limit is asked for, with defaults for columns that lack or hold nothing."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(
            name,
            F.coalesce(
                F.col(name).try_cast({int: "long", float: "double", bool: "boolean"}.get(type(value), "string")), F.lit(value)
            ) if name in rows.columns else F.lit(value)
        )
    return rows if most is None else rows.orderBy(order).limit(most)


def with_earlier(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """The rows of the manifest at ``path``, if there is one, and those of ``new``, repeated ones too, to be written elsewhere.

    Columns go by name: what one side lacks is null there, and the earlier rows take the types of ``new``. Without new rows the earlier stay.
    """
    try:
        old = read_manifest(spark, path)
    except AnalysisException as e:
        if _missing(e):
            return new
        raise
    types = dict(new.dtypes)
    return old.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in old.columns]).unionByName(new, allowMissingColumns=True)


def detections_to_regions(rows: DataFrame, least_conf: float = 0.0) -> DataFrame:
    """image and regions from detector rows (image, x1, y1, x2, y2, class number, conf): by falling confidence, texts empty."""
    kind = F.element_at(F.array(*[F.lit(t) for t in REGION_TYPES]), F.col("class") + 1)
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    one = F.struct(
        box.alias("bbox"), kind.alias("type"), F.lit("").alias("text"), F.lit("uk").alias("language"), F.lit("legible").alias("legibility"),
        F.col("conf").cast("double").alias("conf")
    )
    keyed = F.struct((-F.col("conf")).alias("k"), box.alias("b"), one.alias("r"))
    return rows.where(F.col("conf") >= least_conf).groupBy("image").agg(
        F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["r"]).alias("regions")
    )
