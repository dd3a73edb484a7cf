"""Detector settings: non-maximum suppression, and the page metric over grids of confidence, suppression limit and match threshold.

A grid is scored from one table of pairs. Overlaps, normalised texts and edit distances of matched texts are computed once for a page; each
point keeps some of the predictions, takes its pairs in turn and sums up what they have. Page texts that several points share are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import sweep
from ..functions.edits import edit_distances
from ..functions.markup import rewrite_markup_array
from ..functions.regions import is_scorable
from .pages import THRESHOLD, crossed_items, finish_texts, held, markup_texts, metric_columns, overlapping_pairs, read_as, taken_in_turn


def _conf(r: Column) -> Column:
    return F.coalesce(r["conf"], F.lit(1.0))


def stays(regions: Column, limit: float, by_type: bool = True) -> Column:
    """Which regions stay: by falling confidence, then by position, each removes those of its type (or all) that overlap it by more than ``limit``.

    A null confidence is 1. The limit is at least 0. All but the smallest pages go to an Arrow function, where crowded ones are swept.
    """
    return F.get(stays_at(regions, [limit], by_type), F.lit(0))


def stays_at(regions: Column, limits: list[float], by_type: bool = True) -> Column:
    """``stays`` for each of the limits, whose pairs are found once."""
    kind = (lambda r: r["type"]) if by_type else (lambda r: F.lit("").cast("string"))
    ranked = F.array_sort(
        F.transform(regions, lambda r, i: F.struct((-_conf(r)).alias("c"), i.alias("i"), kind(r).alias("t"), r["bbox"].alias("b")))
    )

    def meets(a: Column, b: Column) -> Column:
        return (a[1] < b[3]) & (b[1] < a[3]) & (a[0] < b[2]) & (b[0] < a[2])

    def small(limit: float) -> Column:
        def take(kept: Column, x: Column) -> Column:
            gone = F.exists(kept, lambda k: k["t"].eqNullSafe(x["t"]) & meets(k["b"], x["b"]) & (G.iou_metric(k["b"], x["b"]) > limit))
            return F.when(gone, kept).otherwise(F.concat(kept, F.array(x)))

        none = F.array().cast("array<struct<c:double,i:int,t:string,b:array<double>>>")
        kept = F.transform(F.aggregate(ranked, none, take), lambda k: k["i"])
        return F.transform(regions, lambda r, i: F.array_contains(kept, i))

    large = sweep.is_large(regions, regions)
    at = F.array(*[F.lit(float(m)) for m in limits]).cast("array<double>")
    swept = sweep.stays_large(F.when(large, sweep.of_boxes(regions)), F.when(large, F.transform(regions, kind)), F.when(large, F.transform(regions, _conf)), at)
    return F.when(large, swept).otherwise(F.array(*[small(m) for m in limits]).cast("array<array<boolean>>"))


def suppress(rows: DataFrame, limit: float, conf: float = 0.0, by_type: bool = True) -> DataFrame:
    """``rows`` with only the regions of at least ``conf`` that suppression leaves, in their order.

    A region below ``conf`` never removes one above it, so both filters stand side by side.
    """
    marked = held(rows.withColumn("__stays", stays(F.col("regions"), limit, by_type)))
    kept = F.filter("regions", lambda r, i: F.get("__stays", i) & (_conf(r) >= conf))
    return marked.withColumn("regions", kept).drop("__stays")


def _page_parts(regions: Column, texts: Column) -> Column:
    """Scorable regions in reading order: t (text) and i (position)."""
    keyed = F.transform(
        regions,
        lambda r, i: F.struct(
            F.floor((r["bbox"][1] + r["bbox"][3]) / 2 / 15).alias("row"), ((r["bbox"][0] + r["bbox"][2]) / 2).alias("x"), i.alias("i"),
            F.get(texts, i).alias("t"), is_scorable(r).alias("ok")
        )
    )
    return F.sort_array(F.filter(keyed, lambda k: k["ok"]))


def beside(solution: DataFrame, submission: DataFrame) -> DataFrame:
    """image, gt and pred: each page of ``solution`` with its predictions, none where ``submission`` lacks it."""
    sub = submission.select("image", F.col("regions").alias("pred"))
    return solution.select("image", F.col("regions").alias("gt")).join(sub, "image", "left")


def pair_table(rows: DataFrame, least: float) -> DataFrame:
    """A row for each of ``rows`` (image, gt and pred): its regions, the predictions, and all pairs that reach ``least`` (over 0) with what a match of them is worth.

    Columns: image, gt, pred, pairs (o, gi, pi) by falling overlap, worth (cer or null, same type, whether the reference is scorable) beside
    them, gt_page, and parts (the predictions' texts in reading order).
    """
    for name in ("gt", "pred"):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    large = sweep.is_large(F.col("gt"), F.col("pred"))
    swept = sweep.pairs_large(F.when(large, sweep.of_boxes(F.col("gt"))), F.when(large, sweep.of_boxes(F.col("pred"))), F.lit(float(least)))
    rows = held(rows.withColumn("pairs", F.when(large, swept).otherwise(overlapping_pairs(F.col("gt"), F.col("pred"), least))))
    rows = held(rows.withColumn("crossed", crossed_items(F.col("gt"), F.col("pred"), F.col("pairs"))))
    for name in ("gt", "pred", "crossed"):
        rows = rows.withColumn(f"{name}_markup", rewrite_markup_array(markup_texts(F.col(name))))
    rows = held(rows)
    for name in ("gt", "pred", "crossed"):
        rows = rows.withColumn(f"{name}_texts", finish_texts(F.col(name), F.col(f"{name}_markup")))
    rows = held(rows)
    rows = held(rows.withColumn("read", read_as(F.col("pairs"), F.col("crossed"), F.col("crossed_texts"), F.col("pred_texts"))))

    def worth(m: Column, k: Column) -> Column:
        g, p = F.get("gt", m["gi"]), F.get("pred", m["pi"])
        want, got = F.get("gt_texts", m["gi"]), F.get("read", k)
        cer = F.when(is_scorable(g), F.when(got == want, 0).otherwise(F.levenshtein(got, want)) / F.greatest(F.length(want), F.lit(1)))
        return F.struct(cer.alias("cer"), (g["type"] == p["type"]).alias("same"), is_scorable(g).alias("ok"))

    page = F.array_join(F.transform(_page_parts(F.col("gt"), F.col("gt_texts")), lambda k: k["t"]), "\n")
    return rows.select(
        "image", "gt", "pred", "pairs", F.transform("pairs", worth).alias("worth"), page.alias("gt_page"),
        F.transform(_page_parts(F.col("pred"), F.col("pred_texts")), lambda k: F.struct(k["i"].alias("i"), k["t"].alias("t"))).alias("parts")
    )


def grid(
    solution: DataFrame, submission: DataFrame, confs: list[float], ious: list[float] = (THRESHOLD,), nms: list[float | None] = (None,), by_type: bool = True
) -> DataFrame:
    """``grid_of`` the pages of ``solution`` beside their predictions in ``submission``."""
    return grid_of(beside(solution, submission), confs, ious, nms, by_type)


def grid_of(
    rows: DataFrame, confs: list[float], ious: list[float] = (THRESHOLD,), nms: list[float | None] = (None,), by_type: bool = True
) -> DataFrame:
    """The metric for each confidence, match threshold (over 0) and suppression limit, over pages (image, gt, pred) whose predictions carry ``conf``.

    ``ordinal`` is the point's place, confidences first, then thresholds, then limits, as the points of a loop over confidences with the others
    inside; ``nms`` is null where nothing is suppressed.
    """
    limits = sorted({float(m) for m in nms if m is not None})
    points = [(float(c), float(t), None if m is None else float(m)) for c in confs for t in ious for m in nms]
    sets = sorted({(c, m) for c, _, m in points}, key=str)  # a point's predictions go by its confidence and limit
    rows = pair_table(rows, min(map(float, ious)))
    rows = rows.withColumn("stays", stays_at(F.col("pred"), limits, by_type))
    of_sets = F.array(*[F.struct(F.lit(c).alias("conf"), F.lit(None if m is None else limits.index(m)).cast("int").alias("limit")) for c, m in sets])
    of_points = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(t).alias("least"), F.lit(sets.index((c, m))).alias("set")) for k, (c, t, m) in enumerate(points)])
    rows = held(rows.withColumns({"sets": of_sets, "points": of_points}))

    def kept(s: Column) -> Column:
        return F.transform("pred", lambda r, i: (_conf(r) >= s["conf"]) & (s["limit"].isNull() | F.get(F.get("stays", s["limit"]), i)))

    rows = held(rows.withColumn("kept", F.transform("sets", kept)))
    large = sweep.is_large(F.col("gt"), F.col("pred"))
    each, least = F.transform("points", lambda p: F.get("kept", p["set"])), F.transform("points", lambda p: p["least"])
    rows = rows.withColumn("swept", sweep.taken_large(F.when(large, F.col("pairs")), F.when(large, each), least))

    def folded(point: Column) -> Column:
        mine = F.filter("pairs", lambda p: (p["o"] <= -point["least"]) & F.get(F.get("kept", point["set"]), p["pi"]))
        there = F.transform(F.array(taken_in_turn(mine)), lambda took: F.filter(
            F.transform("pairs", lambda p, n: F.when(F.array_contains(took, F.struct(p["gi"].alias("gi"), p["pi"].alias("pi"))), n)), lambda n: n.isNotNull()
        ))
        return F.get(there, F.lit(0))

    small = F.transform("points", folded)
    rows = held(rows.withColumn("taken", F.when(F.col("swept").isNotNull(), F.col("swept")).otherwise(small)))

    def result(point: Column, k: Column) -> Column:
        taken, mine = F.get("taken", k), F.get("kept", point["set"])
        got = F.transform(taken, lambda n: F.get("worth", n))
        cers = F.filter(F.transform(got, lambda w: w["cer"]), lambda c: c.isNotNull())
        gone = F.transform(F.filter(taken, lambda n: ~F.get("worth", n)["ok"]), lambda n: F.get("pairs", n)["pi"])
        # lists that a lambda uses are bound by one of their own, so that they are made once for a page
        there = F.get(F.transform(
            F.array(F.struct(mine.alias("mine"), gone.alias("gone"))),
            lambda x: F.filter("parts", lambda t: F.get(x["mine"], t["i"]) & ~F.array_contains(x["gone"], t["i"]))
        ), F.lit(0))
        n_pred = F.size(F.filter(mine, lambda x: x))
        return F.struct(
            point["ordinal"].alias("ordinal"), F.size(taken).alias("tp"), (n_pred - F.size(taken)).alias("fp"), (F.size("gt") - F.size(taken)).alias("fn"),
            F.size(F.filter(got, lambda w: w["same"])).alias("class_correct"), F.aggregate(cers, F.lit(0.0), lambda a, c: a + c).alias("cer_sum"),
            F.size(cers).alias("cer_n"), F.array_join(F.transform(there, lambda t: t["t"]), "\n").alias("page")
        )

    rows = held(rows.select("gt_page", F.transform("points", result).alias("found")))
    rows = held(rows.withColumn("pages", F.array_distinct(F.transform("found", lambda p: p["page"]))))
    far = F.when(F.length("gt_page") > 0, F.transform("distances", lambda n: n / F.length("gt_page")))
    rows = held(rows.withColumn("distances", edit_distances(F.col("pages"), F.col("gt_page"))))
    rows = held(rows.withColumn("far", far)).select("pages", "far", F.explode("found").alias("p"))
    cer = F.get("far", (F.array_position("pages", F.col("p.page")) - 1).cast("int"))
    scored = rows.select("p.*", cer.alias("page_cer")).groupBy("ordinal").agg(*metric_columns())
    conf, iou, limit = (F.get(F.array(*[F.lit(p[k]).cast("double") for p in points]), F.col("ordinal")) for k in range(3))
    return scored.withColumns({"conf": conf, "iou": iou, "nms": limit})


def best_of_grid(found: DataFrame) -> DataFrame:
    """The row of the best composite, the earliest on ties."""
    return found.orderBy(F.desc("composite"), "ordinal").limit(1)
