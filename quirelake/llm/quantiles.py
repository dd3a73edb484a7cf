"""Mergeable quantile summaries with exact ranks from a distributed range sort.

Distinct values are counted, dealt out by ranges of (keys, x) and sorted; each part's running counts start from the counts of the parts before
it, so a key with most of the rows is ranked by many tasks. A summary keeps evenly spaced order statistics. Each of its points bounds how many
rows lie below x (lt_lo to lt_hi) and how many at or below it (le_lo to le_hi); within a batch both are exact. Merged, a point's bounds are the
sums of what each summary says of x: its own bounds, or those between the points on either side. Everything is DataFrame operations; nothing
is collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, discard

#: Evenly spaced points of a batch's summary; with the LEAST smallest values eight batches hold 384 points.
POINTS = 44
#: So many of the smallest distinct values are always points.
LEAST = 4
#: Points of a merged summary, beyond which it is thinned.
MOST = 400


def value_counts(rows: DataFrame, keys: list[str], x: str = "x", times: str | None = None) -> DataFrame:
    """How often each x occurs for its keys, a row standing for ``times`` rows: keys, x, c. Rows without x are left out; null keys are keys like others."""
    one = F.col(times) if times else F.lit(1)
    return rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.sum(one).cast("long").alias("c"))


def exact_ranks(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to (keys, x, c): below and upto (the key's rows under x, and up to it), nth (x among its distinct values), n (its rows).

    Each part of the range sort holds many keys, or a stretch of one; the parts' counts are summed by key, at most one row a part, and lead
    their part as its first row. An empty table gives an empty result.
    """
    ranged = cut(counts.repartitionByRange(*keys, "x").select(*keys, "x", "c", F.spark_partition_id().alias("__part")), "ranged")
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"))
    leads = parts.select(
        *keys, "__part", F.lit(True).alias("__lead"), F.lit(None).cast("long").alias("x"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"),
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d"), F.sum("c").over(Window.partitionBy(*keys)).alias("n")
    )
    rows = ranged.select(
        *keys, "__part", F.lit(False).alias("__lead"), F.col("x").cast("long").alias("x"), "c", F.lit(1).cast("long").alias("d"), F.lit(None).cast("long").alias("n")
    )
    part = Window.partitionBy(*keys, "__part").orderBy(F.desc("__lead"), "x").rowsBetween(Window.unboundedPreceding, 0)
    ranks = leads.unionByName(rows).select(
        *keys, "x", "c", "__lead", (F.sum("c").over(part) - F.col("c")).alias("below"), F.sum("c").over(part).alias("upto"),
        F.sum("d").over(part).alias("nth"), F.first("n").over(part).alias("n")
    ).where(~F.col("__lead")).drop("__lead")
    out = cut(ranks, "ranks")
    discard(ranged)
    return out


def _share(count: str, points: int) -> Column:
    return F.expr(f"{count} * {points} div n")


def summarise(ranks: DataFrame, keys: list[str], points: int = POINTS) -> DataFrame:
    """The points of each key's summary: keys, x, lt_lo, lt_hi, le_lo, le_hi, n; at most ``points`` + LEAST of them.

    Kept are the values at ranks ceil(j * n / points), so the largest too, and the smallest LEAST distinct ones.
    """
    even = _share("upto", points) > _share("below", points)
    return ranks.where(even | (F.col("nth") <= LEAST)).select(
        *keys, "x", F.col("below").alias("lt_lo"), F.col("below").alias("lt_hi"), F.col("upto").alias("le_lo"), F.col("upto").alias("le_hi"), "n"
    )


def merge(summaries: DataFrame, keys: list[str], part: str, most: int = MOST) -> DataFrame:
    """The summaries of all parts of each key as one, from their points alone; over ``most`` points are thinned to about ``most``.

    Between two points of a part, x has at least the rows up to the lower one and at most those below the upper one. These are step functions
    of x, so their sums over parts are running sums of the steps. A task holds the points of one key's parts: many parts are merged in rounds,
    since what comes out can be merged again.
    """
    own = Window.partitionBy(*keys, part).orderBy("x")
    ahead, behind = F.coalesce(F.lead("lt_hi").over(own), F.col("n")), F.coalesce(F.lag("le_lo").over(own), F.lit(0))
    first = F.lag("x").over(own).isNull()
    steps = summaries.select(
        *keys, "x", F.when(first, F.col("n")).otherwise(0).alias("n"), (F.col("le_lo") - behind).alias("lo"), (F.col("lt_lo") - behind).alias("at_lo"),
        (ahead - F.col("lt_hi")).alias("hi"), (F.col("le_hi") - ahead).alias("at_hi")
    ).groupBy(*keys, "x").agg(*[F.sum(c).alias(c) for c in ("n", "lo", "at_lo", "hi", "at_hi")])
    every = Window.partitionBy(*keys)
    upto = every.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    from_ = every.orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    n, lo, hi = F.sum("n").over(every), F.sum("lo").over(upto), F.sum("hi").over(from_)
    merged = steps.select(
        *keys, "x", (lo - F.col("lo") + F.col("at_lo")).alias("lt_lo"), (n - hi).alias("lt_hi"), lo.alias("le_lo"),
        (n - hi + F.col("hi") + F.col("at_hi")).alias("le_hi"), n.alias("n")
    )
    return thin(merged, keys, most)


def thin(summaries: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """Summaries of over ``most`` points with only those at evenly spaced ranks, the smallest LEAST and the last."""
    by = Window.partitionBy(*keys).orderBy("x")
    marked = summaries.select(
        "*", F.row_number().over(by).alias("__nth"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__points"),
        F.coalesce(F.lag("le_lo").over(by), F.lit(0)).alias("__behind")
    )
    even = _share("le_lo", most - LEAST) > _share("__behind", most - LEAST)
    return marked.where((F.col("__points") <= most) | (F.col("__nth") <= LEAST) | even).drop("__nth", "__points", "__behind")


def estimate(summaries: DataFrame, keys: list[str], parts: int = 10, least: int = 20) -> DataFrame:
    """What summaries of ``least`` rows or more say of the quantiles i / ``parts``: keys, i, n, target, points and answer.

    target is ceil(i * n / parts). The answer is one of two neighbouring points: the last that surely has fewer than target rows up to it,
    or the first that surely has as many; the one with the smaller bound of its rank error, the lower where both are equal. Answers don't
    decrease in i and lie between the smallest and the largest value.
    """
    by = Window.partitionBy(*keys).orderBy("x")
    behind = F.coalesce(F.lag("le_lo").over(by), F.lit(0))
    points = summaries.where(F.col("n") >= least).select(
        *keys, "n", "x", "lt_hi", F.lag("x").over(by).alias("x0"), F.lag("lt_hi").over(by).alias("hi0"), behind.alias("lo0"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("points"), F.expr(f"{parts} * le_lo div n").alias("to")
    ).withColumn("since", F.expr(f"{parts} * lo0 div n + 1"))
    each = points.where(F.least("to", F.lit(parts - 1)) >= F.col("since")).select(
        "*", F.explode(F.sequence(F.col("since"), F.least("to", F.lit(parts - 1).cast("long")))).alias("i")
    ).withColumn("target", F.expr(f"(i * n + {parts - 1}) div {parts}"))
    error = F.greatest(F.lit(0), F.col("lt_hi") + 1 - F.col("target"))
    error0 = F.greatest(F.col("hi0") + 1 - F.col("target"), F.col("target") - F.col("lo0"))
    answer = F.when(F.col("x0").isNotNull() & (error0 <= error), F.col("x0")).otherwise(F.col("x"))
    return each.select(*keys, F.col("i").cast("int").alias("i"), "n", "target", "points", answer.alias("answer"))


def exact_quantiles(ranks: DataFrame, keys: list[str], parts: int = 10, least: int = 20) -> DataFrame:
    """The ceil(i * n / ``parts``)-th smallest value of each key with ``least`` rows or more: keys, i, exact_x."""
    since, to = F.expr(f"{parts} * below div n + 1"), F.least(F.expr(f"{parts} * upto div n"), F.lit(parts - 1).cast("long"))
    return ranks.where((F.col("n") >= least) & (since <= to)).select(
        *keys, F.explode(F.sequence(since, to)).alias("i"), F.col("x").alias("exact_x")
    ).withColumn("i", F.col("i").cast("int"))


def _same(a: DataFrame, b: DataFrame, on: dict[str, str]) -> Column:
    out = F.lit(True)
    for left, right in on.items():
        out = out & a[left].eqNullSafe(b[right])
    return out


def measured(answers: DataFrame, ranks: DataFrame, keys: list[str], parts: int = 10, least: int = 20) -> DataFrame:
    """Answers beside the truth: adds exact_x, n_below and n_upto (exact counts at the answer) and rank_error."""
    exact = exact_quantiles(ranks, keys, parts, least)
    at = ranks.select(*keys, "x", F.col("below").alias("n_below"), F.col("upto").alias("n_upto"))
    both = answers.join(exact.hint("merge"), _same(answers, exact, {k: k for k in [*keys, "i"]})).select(answers["*"], "exact_x")
    out = both.join(at.hint("merge"), _same(both, at, {k: k for k in keys} | {"answer": "x"})).select(both["*"], "n_below", "n_upto")
    error = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return out.withColumn("rank_error", error)


def batch_quantiles(rows: DataFrame, keys: list[str], batch: str, x: str = "x", times: str | None = None, parts: int = 10, least: int = 20) -> DataFrame:
    """Quantiles of each batch of each key, and of each key as a whole (batch -1) from its batches' summaries alone, beside the truth.

    One row per key, batch and i from 1 to ``parts`` - 1: keys, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error.
    Batches are whole numbers from 0; a row stands for ``times`` rows, a positive column, if that is given. Rows without x are left out; null keys are keys like others; repeated rows count each; summaries of fewer
    than ``least`` rows give no row, though they count in the whole; columns other than the keys, batch and x are not read; an empty table
    gives an empty result.
    """
    one = F.col(times) if times else F.lit(1)
    plain = rows.select(*keys, F.col(batch).cast("int").alias("batch"), F.col(x).cast("long").alias("x"), one.cast("long").alias("times"))
    parted = value_counts(plain, [*keys, "batch"], times="times")
    whole = parted.groupBy(*keys, "x").agg(F.sum("c").alias("c")).select(*keys, F.lit(-1).alias("batch"), "x", "c")
    ranks = exact_ranks(parted.unionByName(whole), [*keys, "batch"])
    batches = summarise(ranks.where("batch >= 0"), [*keys, "batch"])
    merged = merge(batches, keys, "batch").withColumn("batch", F.lit(-1))
    return measured(estimate(batches.unionByName(merged), [*keys, "batch"], parts, least), ranks, [*keys, "batch"], parts, least)
