"""Reports of a sharded run from mergeable states.

A shard writes what its pages add up to: counts, exact decimal sums, and how often each length or error occurs. States are added, so shards can
be merged in any order, or some of them first, and the reports are those of an unsplit run bit for bit. Sketches stand in where a histogram
of all values would be too long; they merge likewise, within their stated errors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import EVENTS, metric_of, type_rates

#: Errors are added as decimals of 18 places: sums of doubles would depend on their order.
EXACT = "decimal(38,18)"
#: Error rates are counted in steps of a millionth.
STEP = 1_000_000
#: log2 of the registers of a distinct-count sketch (standard error about 0.8 %), and the size of a quantile sketch (rank error about 0.9 %).
HLL, KLL = 14, 300


def partial(pages: DataFrame, *by: str) -> DataFrame:
    """The state of page rows (of ``score_pages``): report, key, measure, value; with columns ``by``, such as the shard, one for each of their values.

    Reports: source (sums of the metric), type (events and errors), chars (matched texts of each length), page_cer (pages of each error).
    """

    def entry(report: str, key: Column, measure: Column | str, value: Column | int) -> Column:
        measure = F.lit(measure) if isinstance(measure, str) else measure
        value = F.lit(value) if isinstance(value, int) else value
        return F.struct(F.lit(report).alias("report"), key.cast("string").alias("key"), measure.alias("measure"), value.cast(EXACT).alias("value"))

    def each(name: str, measure: str, of=lambda x: x) -> Column:
        return F.transform(name, lambda x: entry("type", of(x), measure, 1))

    scored = F.filter("matches", lambda m: m["cer"].isNotNull())
    same = F.filter("matches", lambda m: m["gt_type"] == m["pred_type"])
    sums = {c: F.col(c) for c in ("tp", "fp", "fn", "class_correct", "cer_n", "cer_sum")}
    sums |= {"page_cer_sum": F.col("page_cer"), "page_cer_n": F.col("page_cer").isNotNull().cast("int"), "pages": F.lit(1)}
    entries = F.concat(
        F.array(*[entry("source", F.col("source"), m, v) for m, v in sums.items()], entry("page_cer", F.round(F.col("page_cer") * STEP).cast("long"), "n", F.when(F.col("page_cer").isNotNull(), 1))),
        each("gt_types", "gt"), each("pred_types", "pred"), each("lost_gt", "fn"), each("lost_pred", "fp"),
        each("matches", "matched", lambda m: m["gt_type"]), each("matches", "matched_pred", lambda m: m["pred_type"]),
        F.transform(same, lambda m: entry("type", m["gt_type"], "correct", 1)), F.transform(scored, lambda m: entry("type", m["gt_type"], "cer_n", 1)),
        F.transform(scored, lambda m: entry("type", m["gt_type"], "cer_sum", m["cer"])), F.transform("matches", lambda m: entry("chars", m["chars"], "n", 1))
    )
    # one pass over the page rows, whose entries are added up before they are shuffled
    return pages.select(*by, F.explode(entries).alias("e")).select(*by, "e.*").where("value IS NOT NULL").groupBy(*by, "report", "key", "measure").agg(
        F.sum("value").cast(EXACT).alias("value")
    )


def merge(*states: DataFrame) -> DataFrame:
    """The state of all pages of ``states``, which may themselves be merged. No page may be in two of them."""
    return reduce(DataFrame.unionByName, states).groupBy("report", "key", "measure").agg(F.sum("value").cast(EXACT).alias("value"))


def write_shard(state: DataFrame, path: str, shard: int) -> None:
    """Write one shard's state; written again, it takes the place of what was there."""
    merge(state).write.mode("overwrite").parquet(f"{path}/shard={int(shard)}")


def read_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """The merged state of all ``shards``; fails if one is missing."""
    return merge(*[spark.read.parquet(f"{path}/shard={k}") for k in range(shards)])


def _wide(state: DataFrame, report: str, measures: tuple[str, ...]) -> DataFrame:
    mine = state.where(F.col("report") == report)
    return mine.groupBy("key").agg(*[F.sum(F.when(F.col("measure") == m, F.col("value"))).cast(EXACT).alias(m) for m in measures])


_METRIC = ("tp", "fp", "fn", "class_correct", "cer_sum", "cer_n", "page_cer_sum", "page_cer_n")


def _finish(sums: DataFrame, *keys: str) -> DataFrame:
    c = {m: F.col(m).cast("double") for m in _METRIC}
    return sums.select(
        *keys, *metric_of(c["tp"], c["fp"], c["fn"], c["class_correct"], c["cer_sum"], c["cer_n"], c["page_cer_sum"] / F.nullif(c["page_cer_n"], F.lit(0.0)))
    )


def metric(state: DataFrame) -> DataFrame:
    """The page metric, one row."""
    return _finish(_wide(state, "source", _METRIC).agg(*[F.sum(m).cast(EXACT).alias(m) for m in _METRIC]))


def metric_by_source(state: DataFrame) -> DataFrame:
    return _finish(_wide(state, "source", _METRIC).withColumnRenamed("key", "source"), "source")


def types(state: DataFrame) -> DataFrame:
    """The report by type."""
    rows = _wide(state, "type", (*EVENTS, "cer_sum", "cer_n"))
    n = {k: F.coalesce(F.col(k).cast("long"), F.lit(0)) for k in EVENTS}
    mean = F.col("cer_sum").cast("double") / F.nullif(F.col("cer_n").cast("double"), F.lit(0.0))
    return rows.select(F.col("key").alias("type"), *type_rates(n, mean, F.coalesce(F.col("cer_n").cast("long"), F.lit(0))))


def quantiles(state: DataFrame, report: str, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """share, n and value at rank ceil(share * n) of the values that ``report`` (chars, page_cer) counts; errors in millionths."""
    counts = state.where(F.col("report") == report).groupBy(F.col("key").cast("long").alias("v")).agg(F.sum("value").cast("long").alias("k"))
    ranked = counts.selectExpr("v", "k", "sum(k) OVER (ORDER BY v) AS upto", "sum(k) OVER () AS n")  # one row for each distinct value
    each = ranked.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("at", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)))
    return each.where("upto >= at AND upto - k < at").select("share", "n", F.col("v").alias("value"))


def sketch(rows: DataFrame, keys: list[str], distinct: str | None = None, numbers: str | None = None) -> DataFrame:
    """A state of bounded size for each key: ``distinct_sketch`` of a column's values, ``rank_sketch`` of a whole-number column."""
    parts = []
    if distinct:
        parts.append(F.hll_sketch_agg(F.col(distinct), F.lit(HLL)).alias("distinct_sketch"))
    if numbers:
        parts.append(F.kll_sketch_agg_bigint(F.col(numbers).cast("long"), KLL).alias("rank_sketch"))
    return rows.groupBy(*keys).agg(*parts)


def merge_sketches(*states: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of all ``states`` as one for each key."""
    both = reduce(DataFrame.unionByName, states)
    parts = []
    if "distinct_sketch" in both.columns:
        parts.append(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    if "rank_sketch" in both.columns:
        parts.append(F.kll_merge_agg_bigint("rank_sketch", KLL).alias("rank_sketch"))
    return both.groupBy(*keys).agg(*parts)


def sketched(state: DataFrame, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """What sketches say: ``distinct`` and, for each of ``shares``, p50, p90 and so on."""
    out = [c for c in state.columns if not c.endswith("_sketch")]
    if "distinct_sketch" in state.columns:
        out.append(F.hll_sketch_estimate("distinct_sketch").alias("distinct"))
    if "rank_sketch" in state.columns:
        out += [F.kll_sketch_get_quantile_bigint("rank_sketch", F.lit(float(s))).alias(f"p{round(100 * s)}") for s in shares]
    return state.select(*out)
