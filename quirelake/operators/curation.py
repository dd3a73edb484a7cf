"""Dataset curation: audit, split, manifests, leakage, weights and quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regions import audit_scorable
from ..functions.text import canonical_type, is_valid_label
from ..schema import REGION_TYPES
from ..sources.regions import first_list, first_text
from ..sources.shared import fresh_folder


class Leakage(ValueError):
    """Pages stand on both sides of a split."""


def audit(pages: DataFrame) -> DataFrame:
    """One row about the regions of pages: counts, scorable share (4 places), text lengths (1 place), long texts and rare types.

    Types rare by more than ten times against the commonest are listed when the imbalance between present types passes ten.
    """
    rows = pages.select(F.explode(first_list("regions", "annotations", "labels")).alias("r"))
    kind, text, ok = F.coalesce("r.type", F.lit("handwritten")), F.coalesce("r.text", F.lit("")), audit_scorable(F.col("r"))
    n = {t: F.count_if(kind == t) for t in REGION_TYPES}
    every = F.array(*n.values())
    length = F.when(ok, F.length(text))
    top, least = F.array_max(every), F.array_min(F.filter(every, lambda c: c > 0))
    rare = F.array_compact(F.array(*[F.when(c < top * 0.1, F.lit(t)) for t, c in n.items()]))
    return rows.agg(
        F.count("*").alias("total_regions"),
        F.count_if(ok).alias("scorable_regions"),
        F.bround(F.count_if(ok) / F.greatest(F.count("*"), F.lit(1)), 4).alias("scorable_ratio"),
        F.bround(F.coalesce(F.avg(length), F.lit(0.0)), 1).alias("avg_text_len"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_text_len"),
        F.count_if(length > 256).alias("long_texts"),
        F.when(top / F.greatest(F.coalesce(least, F.lit(1)), F.lit(1)) > 10, rare).otherwise(F.array().cast("array<string>")).alias("rare_types"),
    )


def type_histogram(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.explode(first_list("regions", "annotations", "labels")).alias("r")
    ).groupBy(F.coalesce("r.type", F.lit("handwritten")).alias("type")).agg(F.count("*").alias("n"))


def source_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("pages"))


def n_valid(n: Column, share: float = 0.1) -> Column:
    """Validation rows of a source with n: a tenth but 20 at least from 51 on, else a fifth but one at least."""
    return F.when(n > 50, F.greatest(F.lit(20), F.floor(n * share))).otherwise(F.greatest(F.lit(1), F.floor(n / 5)))


def _hashed(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with __h, the md5 of seed and key, and __k, the key as text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return rows.withColumns({"__h": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), "__k": text})


def _cuts(hashed: DataFrame, quota: DataFrame, digits: int = 3) -> DataFrame:
    """__g, __ch and __ck: the hash and key of the row of rank ``__quota`` (in ``quota`` by __g, at most the group's rows) by (__h, __k).

    Counts of hash prefixes name the one prefix of each group in which that rank lies; only its rows are ordered, by hash and key alone.
    """
    narrow = hashed.select("__g", "__h", "__k", F.substring("__h", 1, digits).alias("__b"))
    counts = narrow.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    asked = quota.select(F.col("__g").alias("__qg"), "__quota")
    where = counts.withColumn("__upto", upto).join(asked, F.col("__g").eqNullSafe(F.col("__qg"))).select(
        F.col("__g").alias("__wg"), F.col("__b").alias("__wb"), (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__take"), "__n"
    ).where("__take >= 1 AND __take <= __n")
    inside = narrow.join(where, F.col("__g").eqNullSafe(F.col("__wg")) & (F.col("__b") == F.col("__wb")))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy("__h", "__k"))
    return inside.withColumn("__r", rank).where("__r = __take").select("__g", F.col("__h").alias("__ch"), F.col("__k").alias("__ck"))


def _within() -> Column:
    return F.coalesce((F.col("__h") < F.col("__ch")) | ((F.col("__h") == F.col("__ch")) & (F.col("__k") <= F.col("__ck"))), F.lit(False))


def _marked(hashed: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    """``hashed`` with a column ``name``: whether a row is up to its group's cut. Rows meet a table of one row a group."""
    cuts = cuts.select(F.col("__g").alias("__cg"), F.col("__ch"), F.col("__ck"))
    return hashed.join(cuts, F.col("__g").eqNullSafe(F.col("__cg")), "left").withColumn(name, _within()).drop("__cg", "__ch", "__ck")


def stratified_split(pages: DataFrame, key: str = "image", source: str = "source", share: float = 0.1, seed: int = 42) -> DataFrame:
    """``pages`` with a column split, valid or train: exact counts per source, by the order of md5(seed, key).

    The last row of a source's quota is found from counts of hash prefixes, and rows are compared with it: whole rows are neither shuffled by
    hash nor ordered. Copies of a key fall on the same side, so where they stand at the end of the quota the count is over it.
    """
    hashed = _hashed(pages, key, seed).withColumn("__g", F.coalesce(F.col(source), F.lit("unknown")))
    quota = hashed.groupBy("__g").agg(n_valid(F.count("*"), share).alias("__quota"))
    marked = _marked(hashed, _cuts(hashed, quota), "__in")
    return marked.withColumn("split", F.when(F.col("__in"), "valid").otherwise("train")).select(*pages.columns, "split")


# Default weights of a manifest's origins.
WEIGHTS = {"gold": 1.0, "silver": 0.5, "synth": 0.3, "hkr": 0.5, "pseudo": 0.7}


def union_manifests(parts: dict[str, DataFrame]) -> DataFrame:
    """One manifest of parts by origin; missing columns are null, missing weights the origin's."""
    out = None
    for origin, part in parts.items():
        weight = F.coalesce(part["weight"], F.lit(WEIGHTS[origin])) if "weight" in part.columns else F.lit(WEIGHTS[origin])
        part = part.withColumn("weight", weight.cast("double")).withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def curriculum(parts: dict[str, DataFrame], stage: int) -> DataFrame:
    """Stage 0: all parts; 1: gold and silver; 2: gold."""
    keep = {0: set(parts), 1: {"gold", "silver"}, 2: {"gold"}}[min(stage, 2)]
    return union_manifests({k: v for k, v in parts.items() if k in keep})


def of_sources(rows: DataFrame, sources: list[str]) -> DataFrame:
    return rows.where(F.col("source").isin(sources))


def leaked(train: DataFrame, valid: DataFrame, key: str = "image") -> DataFrame:
    return train.select(key).intersect(valid.select(key))


def assert_no_leakage(train: DataFrame, valid: DataFrame, key: str = "image") -> None:
    if found := leaked(train, valid, key).limit(5).collect():
        raise Leakage("on both sides: " + ", ".join(str(r[0]) for r in found))


def type_weights(rows: DataFrame, kind: str = "type", cap: float = 4.0) -> DataFrame:
    """type, n and multiplier: the square root of the majority over the type's count, capped."""
    counts = rows.groupBy(canonical_type(F.col(kind)).alias("type")).agg(F.count("*").alias("n"))
    return counts.select("type", "n", F.least(F.lit(cap), F.sqrt(F.max("n").over(Window.partitionBy(F.lit(1))) / F.col("n"))).alias("multiplier"))


def sample_weights(rows: DataFrame, kind: str = "type", weight: str = "weight", cap: float = 4.0) -> DataFrame:
    """``rows`` with sample_weight: base weight times the type's multiplier. At most five types, so their table is broadcast."""
    table = type_weights(rows, kind, cap).select(F.col("type").alias("__t"), "multiplier")
    return rows.join(F.broadcast(table), canonical_type(F.col(kind)) == F.col("__t")).withColumn(
        "sample_weight", F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) * F.col("multiplier")
    ).drop("__t", "multiplier")


#: Weights are added as whole numbers of this part, so that sums don't depend on their order.
UNIT = 1_000_000


def drawn_points(n: int, total: int, seed: int, spark) -> DataFrame:
    """n numbers from 0 to total - 1, each the md5 of seed and its place."""
    digest = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.col("id").cast("string"))), 1, 15)
    return spark.range(n).select((F.conv(digest, 16, 10).cast("long") % F.lit(total)).alias("__p"))


def weighted_sample(rows: DataFrame, n: int, key: str | None = None, weight: str = "sample_weight", seed: int = 42, digits: int = 3) -> DataFrame:
    """``rows`` drawn exactly n times with replacement, by weight: the rows that are drawn, with how often (``draws``).

    Keys are laid end to end by md5(seed, key), each as long as its weight (in millionths); n points, hashes of the seed and their places, fall
    on them. Only keys and weights are ordered, in blocks of a hash prefix; points meet keys by cells of the line, of which each holds one
    point on average. The result depends on neither order nor partitioning. Rows that share a key are one: their weights add up, and one of
    them is returned; without ``key`` that is a row's own JSON text. Rows without a positive weight are never drawn; without any, the result
    is empty.
    """
    spark = rows.sparkSession
    if key is None:
        keyed = rows.withColumn("__key", F.md5(F.to_json(F.struct(*rows.columns))))
        return weighted_sample(keyed, n, "__key", weight, seed, digits).drop("__key")
    units = F.round(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) * UNIT).cast("long")
    each = _hashed(rows.select(F.col(key), units.alias("__u")).where("__u > 0").groupBy(key).agg(F.sum("__u").alias("__u")), key, seed)
    each = each.withColumn("__b", F.substring("__h", 1, digits))
    total = each.agg(F.sum("__u")).first()[0]
    schema = rows.withColumn("draws", F.lit(0).cast("long")).schema
    if not total or n <= 0:
        return spark.createDataFrame([], schema)
    blocks = each.groupBy("__b").agg(F.sum("__u").alias("__t"))  # 16 ** digits at most
    base = blocks.select("__b", (F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).alias("__base"))
    running = F.sum("__u").over(Window.partitionBy("__b").orderBy("__h", "__k").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("__to", running).join(base, "__b").select(
        key, (F.col("__base") + F.col("__to") - F.col("__u")).alias("__lo"), (F.col("__base") + F.col("__to")).alias("__hi")
    )
    width = -(-total // n)
    cell = lambda c: F.expr(f"({c}) div {width}L")
    cells = placed.select("*", F.explode(F.sequence(cell("__lo"), cell("__hi - 1"))).alias("__cell"))
    points = drawn_points(n, total, seed, spark).withColumn("__cell", cell("__p"))
    found = points.join(cells, "__cell").where("__p >= __lo AND __p < __hi").groupBy(key).agg(F.count("*").alias("draws"))
    found = found.select(F.col(key).alias("__drawn"), "draws")
    return rows.where(units > 0).dropDuplicates([key]).join(found, F.col(key).eqNullSafe(F.col("__drawn"))).select(*rows.columns, "draws")


def ranked(rows: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 by ``order``, without one task that sees all of them.

    Rows are sorted by ranges into a table in the shared folder; each part is numbered by itself, from the sum of the counts of the parts
    before it, of which there are as many rows as parts. Rows that tie are numbered as they come.
    """
    spark = rows.sparkSession
    path = fresh_folder(spark, "ranked")
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    base = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__own", own).join(base, "__part").withColumn(rank, (F.col("__base") + F.col("__own")).cast("long")).select(*rows.columns, rank)


def repeat_to(rows: DataFrame, n: int, order: str) -> DataFrame:
    """Rows repeated in turn until there are n: all of them as often as they fit, and the first by ``order`` once more."""
    have = rows.count()
    if not have:
        return rows
    whole, rest = divmod(n, have)
    times = (F.col("__rank") <= rest).cast("int") + whole
    if not rest:
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))).select(*rows.columns)
    several = ranked(rows, [order], "__rank").withColumn("__times", times).where("__times > 0")
    return several.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*rows.columns)


def sqrt_quota(rows: DataFrame, n: int, kind: str = "type", key: str = "image_path", seed: int = 42) -> DataFrame:
    """n rows at most: each type's share goes by the square root of its count, one at least; what is left over is filled from the rest.

    Rows of a type, and then the rest, are taken by the order of md5(seed, key). As in ``stratified_split`` only the last row that is taken is
    looked for, from counts of hash prefixes, and rows are compared with it.
    """
    every = Window.partitionBy(F.lit(1))  # a row for each type
    counts = rows.groupBy(F.col(kind).alias("__g")).agg(F.count("*").alias("__c"))
    quota = counts.select(
        "__g", "__c", F.least(F.col("__c"), F.greatest(F.lit(1), F.bround(F.lit(n) * F.sqrt("__c") / F.sum(F.sqrt("__c")).over(every)).cast("long"))).alias("__quota")
    )
    have, total = quota.agg(F.coalesce(F.sum("__quota"), F.lit(0)), F.coalesce(F.sum("__c"), F.lit(0))).first()
    if total <= n:
        return rows
    hashed = _hashed(rows, key, seed).withColumn("__g", F.col(kind))
    own = _marked(hashed, _cuts(hashed, quota.select("__g", "__quota")), "__own")
    # over all types: what is still to be filled from the rest, or the first n of what the types chose
    pool = F.col("__own") if have >= n else ~F.col("__own")
    last = own.withColumn("__g", F.lit(0)).where(pool)
    wanted = rows.sparkSession.createDataFrame([(0, n if have >= n else n - have)], "__g int, __quota long")
    both = _marked(own.withColumn("__g", F.lit(0)), _cuts(last, wanted), "__fill")
    chosen = F.col("__own") & F.col("__fill") if have >= n else F.col("__own") | F.col("__fill")
    return both.where(chosen).select(*rows.columns)


def class_weight_hint(counts: DataFrame) -> DataFrame:
    """min(1.5, 0.7 * (greatest / least) ** 0.2) over counts of classes."""
    some = counts.where("n > 0")
    return some.agg(F.least(F.lit(1.5), 0.7 * F.pow(F.max("n") / F.min("n"), F.lit(0.2))).alias("cls_weight"))


def external_quality(rows: DataFrame) -> DataFrame:
    """External crops with texts of 2 to 80 characters and, where sizes are known, at least 10 by 5 pixels."""
    ok = F.length(F.trim("text")).between(2, 80)
    if {"width", "height"} <= set(rows.columns):
        ok = ok & F.coalesce((F.col("width") >= 10) & (F.col("height") >= 5), F.lit(True))
    return rows.where(ok)


def valid_pseudo_labels(rows: DataFrame) -> DataFrame:
    return rows.where(is_valid_label(F.col("text")))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Distinct trimmed texts."""
    return rows.select(F.trim("text").alias("text")).where("text <> ''").distinct()


def valid_solution(pages: DataFrame) -> DataFrame:
    """image and regions for a validation solution; regions come from regions or annotations, not labels."""
    return pages.select(
        first_text("image", "file_name", "id").alias("image"), F.coalesce("source", F.lit("unknown")).alias("source"),
        first_list("regions", "annotations").alias("regions")
    )


def run_model(rows: DataFrame, predict, kind: str = "type", text: str = "text", least_batch: int = 1) -> DataFrame:
    """``rows`` with ``text`` from ``predict(type, frame) -> list[str]``, called with rows of one type at a time.

    A MemoryError halves the batch down to ``least_batch`` rows. Order within a batch is kept; ``predict`` runs in the executors. Rows stay in
    their tasks, sorted by type, so no type's rows are bounded in how many tasks they have.
    """
    schema = rows.schema if text in rows.columns else rows.withColumn(text, F.lit("")).schema

    def halving(t: str, frame: pd.DataFrame) -> list[str]:
        try:
            return list(predict(t, frame))
        except MemoryError:
            if len(frame) <= least_batch:
                raise
            half = len(frame) // 2
            return halving(t, frame.iloc[:half]) + halving(t, frame.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.assign(**{text: None})
            for t, part in b.groupby(kind, sort=True, dropna=False):
                out.loc[part.index, text] = halving(t, part)
            yield out[schema.names]

    return rows.sortWithinPartitions(kind).mapInPandas(run, schema)
