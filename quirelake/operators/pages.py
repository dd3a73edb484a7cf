"""The page metric. Each page keeps its regions as arrays: reference and predicted pages meet in one join, and matching, text and errors are
higher-order functions of that row, so a page never leaves its task. All reports are aggregates over page rows or exploded matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import sweep
from ..functions.edits import edit_distance
from ..functions.markup import rewrite_markup_array
from ..functions.regions import is_scorable
from ..functions.text import HEIGHT_BINS, LENGTH_BINS, bin_label, finish_markup, normalize_natural
from ..schema import MARKUP

THRESHOLD = 0.5
# Shares of detection F1, class accuracy, region and page text in the composite.
SHARES = (0.15, 0.05, 0.30, 0.50)
_PAIR = "array<struct<gi:int,pi:int>>"


class MissingImages(ValueError):
    """The submission lacks images of the solution."""


def held(rows: DataFrame) -> DataFrame:
    """``rows`` with its columns computed once: a generator of one row, which the optimiser doesn't merge with the projections around it."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")


def last_of_each(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each image by ``order``."""
    return rows.groupBy("image").agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def check_images(solution: DataFrame, submission: DataFrame) -> None:
    """Raise if images are missing, naming up to five."""
    missing = solution.select("image").join(submission.select("image"), "image", "left_anti").orderBy("image").limit(5).collect()
    if missing:
        raise MissingImages("missing images: " + ", ".join(r["image"] for r in missing))


def overlapping_pairs(gt: Column, pred: Column, threshold: float | Column) -> Column:
    """o (the overlap, negative), gi and pi of pairs that reach ``threshold``, by falling overlap and then by position; all compared with all."""
    # boxes that don't meet are passed over by comparisons, before any overlap is computed
    meets = (
        lambda a, b: (a[1] < b[3]) & (b[1] < a[3]) & (a[0] < b[2]) & (b[0] < a[2])
    ) if isinstance(threshold, Column) or threshold > 0 else (lambda a, b: F.lit(True))
    placed = F.transform(pred, lambda p, pi: F.struct(pi.alias("pi"), p["bbox"].alias("b")))

    def of(all_: Column) -> Column:
        def one(g: Column, gi: Column) -> Column:
            near = F.filter(all_, lambda p: meets(g["bbox"], p["b"]))
            return F.transform(near, lambda p: F.struct((-G.iou_metric(g["bbox"], p["b"])).alias("o"), gi.alias("gi"), p["pi"].alias("pi")))

        return F.filter(F.flatten(F.transform(gt, one)), lambda x: x["o"] <= -threshold)

    return F.array_sort(F.element_at(F.transform(F.array(placed), of), 1))


def taken_in_turn(pairs: Column) -> Column:
    """gi and pi of the pairs each of whose sides no earlier taken pair has."""

    def take(done: Column, x: Column) -> Column:
        used = F.exists(done, lambda d: (d["gi"] == x["gi"]) | (d["pi"] == x["pi"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(F.struct(x["gi"].alias("gi"), x["pi"].alias("pi")))))

    return F.aggregate(pairs, F.array().cast(_PAIR), take)


def greedy_pairs(gt: Column, pred: Column, threshold: float | Column = THRESHOLD) -> Column:
    """One-to-one pairs of positions by falling overlap; equal overlaps by position in ``gt``, then in ``pred``. A threshold that is a column must be over 0.

    On pages of many boxes the pairs come from a sweep, whose cost goes by the boxes that meet, and are taken in one pass.
    """
    small = taken_in_turn(overlapping_pairs(gt, pred, threshold))
    if not isinstance(threshold, Column) and threshold <= 0:
        return small
    large = sweep.is_large(gt, pred)
    at = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    swept = sweep.greedy_large(F.when(large, sweep.of_boxes(gt)), F.when(large, sweep.of_boxes(pred)), at)
    return F.when(large, swept).otherwise(small)


def markup_texts(items: Column) -> Column:
    """Texts of formulas and tables in an array of regions, null elsewhere; null if there are none."""
    todo = F.transform(items, lambda r: F.when(r["type"].isin(*MARKUP), F.coalesce(r["text"], F.lit(""))))
    return F.when(F.exists(items, lambda r: r["type"].isin(*MARKUP)), todo)


def finish_texts(items: Column, rewritten: Column) -> Column:
    """Normalised texts of an array of regions, with the markup's rewriting beside it."""

    def one(r: Column, i: Column) -> Column:
        return F.when(r.isNull(), None).when(r["type"].isin(*MARKUP), finish_markup(F.element_at(rewritten, i + 1), r["type"])).otherwise(normalize_natural(r["text"]))

    return F.transform(items, one)


def crossed_items(gt: Column, pred: Column, pairs: Column) -> Column:
    """For each pair the type and text that the prediction is read with: the reference's type, beside its own text. Null where that is how it is read
    anyway, because both types are the same or neither is markup."""

    def one(m: Column) -> Column:
        g, p = F.get(gt, m["gi"]), F.get(pred, m["pi"])
        alike = g["type"].eqNullSafe(p["type"]) | (~F.coalesce(g["type"].isin(*MARKUP), F.lit(False)) & ~F.coalesce(p["type"].isin(*MARKUP), F.lit(False)))
        return F.when(~alike, F.struct(g["type"].alias("type"), p["text"].alias("text")))

    return F.transform(pairs, one)


def read_as(pairs: Column, crossed: Column, crossed_texts: Column, pred_texts: Column) -> Column:
    """The text of each pair's prediction under the reference's type."""
    return F.transform(pairs, lambda m, k: F.when(F.get(crossed, k).isNull(), F.get(pred_texts, m["pi"])).otherwise(F.get(crossed_texts, k)))


def _page_text(regions: Column, texts: Column, dropped: Column) -> Column:
    kept = F.filter(
        F.transform(
            regions,
            lambda r, i: F.struct(
                F.floor((r["bbox"][1] + r["bbox"][3]) / 2 / 15).alias("row"),
                ((r["bbox"][0] + r["bbox"][2]) / 2).alias("x"),
                i.alias("i"),
                F.element_at(texts, i + 1).alias("t"),
                (is_scorable(r) & ~F.array_contains(dropped, i)).alias("ok"),
            ),
        ),
        lambda k: k["ok"],
    )
    return F.array_join(F.transform(F.sort_array(kept), lambda k: k["t"]), "\n")


def score_pages(solution: DataFrame, submission: DataFrame, threshold: float | str = THRESHOLD, order: str | None = None) -> DataFrame:
    """A row for each row of ``solution`` (image, regions, and source if there is one) with matches, errors and both page texts.

    ``submission`` has image and regions; with ``order`` the last row of an image counts. threshold: a number, or a column of ``solution``. Images it lacks are scored as empty; see
    ``check_images`` for the strict reading. Columns: image, source, n_gt, n_pred, matches (gi, pi, both types, cer or null, text length,
    box height), lost_gt and lost_pred (types), tp, fp, fn, class_correct, cer_sum, cer_n, page_cer (null for an empty reference page),
    gt_chars, pred_chars.
    """
    sub = last_of_each(submission.select("image", "regions", order), order) if order else submission
    sub = sub.select("image", F.col("regions").alias("pred"))
    source = F.coalesce("source", F.lit("unknown")) if "source" in solution.columns else F.lit("unknown")
    at = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    rows = solution.select("image", source.alias("source"), F.col("regions").alias("gt"), at.alias("threshold")).join(sub, "image", "left")
    return _score_joined(_filled(rows, "pred"), F.col("threshold") if isinstance(threshold, str) else threshold)


def score_beside(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``score_pages`` for pages that hold their own predictions, so that nothing is joined: image, source if there is one, gt and pred, null
    where there are none."""
    return _score_joined(_filled(_sourced(rows, "pred"), "pred"), threshold)


def _sourced(rows: DataFrame, *more: str) -> DataFrame:
    source = F.coalesce("source", F.lit("unknown")) if "source" in rows.columns else F.lit("unknown")
    return rows.select("image", source.alias("source"), "gt", *more)


def _filled(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.coalesce(n, F.array().cast(rows.schema[n].dataType)) for n in ("gt", *names)})


def score_variants(solution: DataFrame, variants: DataFrame, name: str, names: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``score_pages`` for each of the submissions in ``variants`` (``name``, image, regions), with ``names``, those that they hold for.

    An image's variants with the same regions are scored once. An image without any is scored as empty for all of ``names``.
    """
    own = variants.groupBy("image").agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col("regions").alias("pred"))).alias("own"))
    return score_own(solution, own, names, threshold)


def score_own(solution: DataFrame, variants: DataFrame, names: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``score_variants`` of pages that hold their variants: image and own (name, pred). Equal variants are one before they are shuffled."""
    rows = solution.withColumnRenamed("regions", "gt")
    return _score_variants(_sourced(rows).join(_unlike(variants.select("image", "own")), "image", "left"), names, threshold)


def score_own_beside(rows: DataFrame, names: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``score_own`` of pages that hold their reference too: image, source if there is one, gt and own, null where there are no variants."""
    return _score_variants(_unlike(_sourced(rows, "own")), names, threshold)


def _unlike(variants: DataFrame) -> DataFrame:
    """``own`` as the names and the regions of each different variant."""
    preds = F.array_distinct(F.transform("own", lambda v: v["pred"]))
    of = lambda pred: F.transform(F.filter("own", lambda v: v["pred"] == pred), lambda v: v["name"])
    own = held(variants.withColumn("preds", preds))
    return own.withColumn("own", F.transform("preds", lambda p: F.struct(of(p).alias("names"), p.alias("pred")))).drop("preds")


def _score_variants(rows: DataFrame, names: list[str], threshold: float) -> DataFrame:
    kind = rows.schema["own"].dataType.elementType["pred"].dataType
    none = F.array(F.struct(F.array(*map(F.lit, names)).alias("names"), F.array().cast(kind).alias("pred")))
    each = _filled(rows).withColumn("own", F.coalesce("own", none)).select("image", "source", "gt", F.explode("own").alias("v"))
    scored = _score_joined(each.select(F.struct("image", "v.names").alias("image"), "source", "gt", "v.pred"), threshold)
    return scored.select(F.col("image.image").alias("image"), F.col("image.names").alias("names"), *[c for c in scored.columns if c != "image"])


def _score_joined(rows: DataFrame, threshold: float | Column) -> DataFrame:
    """Page rows from image, source, gt and pred."""
    rows = rows.withColumn("pairs", greedy_pairs(F.col("gt"), F.col("pred"), threshold))
    # a matched prediction's text is also read under the reference's type
    rows = held(held(rows).withColumn("crossed", crossed_items(F.col("gt"), F.col("pred"), F.col("pairs"))))
    for name in ("gt", "pred", "crossed"):
        rows = rows.withColumn(f"{name}_markup", rewrite_markup_array(markup_texts(F.col(name))))
    rows = held(rows)
    for name in ("gt", "pred", "crossed"):
        rows = rows.withColumn(f"{name}_texts", finish_texts(F.col(name), F.col(f"{name}_markup")))
    rows = held(rows)
    rows = held(rows.withColumn("read", read_as(F.col("pairs"), F.col("crossed"), F.col("crossed_texts"), F.col("pred_texts"))))

    def match(m: Column, k: Column) -> Column:
        g, p = F.element_at("gt", m["gi"] + 1), F.element_at("pred", m["pi"] + 1)
        want, got = F.element_at("gt_texts", m["gi"] + 1), F.element_at("read", k + 1)
        cer = F.when(is_scorable(g), F.when(got == want, 0).otherwise(F.levenshtein(got, want)) / F.greatest(F.length(want), F.lit(1)))
        height = F.greatest(g["bbox"][3].cast("int") - g["bbox"][1].cast("int"), F.lit(0))
        return F.struct(
            m["gi"].alias("gi"), m["pi"].alias("pi"), g["type"].alias("gt_type"), p["type"].alias("pred_type"), cer.alias("cer"),
            F.length(want).alias("chars"), height.alias("height")
        )

    def lost(name: str, side: str) -> Column:
        taken = F.transform("pairs", lambda m: m[side])
        kept = F.filter(F.transform(name, lambda r, i: F.struct(i.alias("i"), r["type"].alias("t"))), lambda x: ~F.array_contains(taken, x["i"]))
        return F.transform(kept, lambda x: x["t"])

    rows = rows.withColumn("matches", F.transform("pairs", match)).withColumn("lost_gt", lost("gt", "gi")).withColumn("lost_pred", lost("pred", "pi"))
    dropped = F.transform(F.filter("pairs", lambda m: ~is_scorable(F.element_at("gt", m["gi"] + 1))), lambda m: m["pi"])
    rows = rows.withColumn(
        "gt_page", _page_text(F.col("gt"), F.col("gt_texts"), F.array().cast("array<int>"))
    ).withColumn("pred_page", _page_text(F.col("pred"), F.col("pred_texts"), dropped))
    rows = held(rows)
    cers = F.filter(F.transform("matches", lambda m: m["cer"]), lambda c: c.isNotNull())
    return rows.select(
        "image",
        "source",
        F.size("gt").alias("n_gt"),
        F.size("pred").alias("n_pred"),
        "matches",
        "lost_gt",
        "lost_pred",
        F.transform("gt", lambda r: r["type"]).alias("gt_types"),
        F.transform("pred", lambda r: r["type"]).alias("pred_types"),
        F.size("pairs").alias("tp"),
        F.size("lost_pred").alias("fp"),
        F.size("lost_gt").alias("fn"),
        F.size(F.filter("matches", lambda m: m["gt_type"] == m["pred_type"])).alias("class_correct"),
        F.aggregate(cers, F.lit(0.0), lambda a, c: a + c).alias("cer_sum"),
        F.size(cers).alias("cer_n"),
        F.when(F.length("gt_page") > 0, edit_distance(F.col("pred_page"), F.col("gt_page")) / F.length("gt_page")).alias("page_cer"),
        F.length("gt_page").alias("gt_chars"),
        F.length("pred_page").alias("pred_chars"),
    )


def metric_of(tp: Column, fp: Column, fn: Column, correct: Column, cer_sum: Column, cer_n: Column, page_cer: Column) -> list[Column]:
    """The composite and all its parts from sums; page_cer is the mean of the pages that have one. Any may be null."""
    one, tiny = F.lit(1.0), F.lit(1e-9)
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    tp, fp, fn = zero(tp), zero(fp), zero(fn)
    precision, recall = tp / F.greatest(tp + fp, one), tp / F.greatest(tp + fn, one)
    f1 = 2 * precision * recall / F.greatest(precision + recall, tiny)
    accuracy = zero(correct) / F.greatest(tp, one)
    region = F.coalesce(cer_sum / F.nullif(cer_n, F.lit(0)), one)
    page = F.coalesce(page_cer, one)
    a, b, c, d = SHARES
    composite = a * f1 + b * accuracy + c * F.greatest(F.lit(0.0), 1 - region) + d * F.greatest(F.lit(0.0), 1 - page)
    return [
        composite.alias("composite"),
        f1.alias("det_f1"),
        precision.alias("det_precision"),
        recall.alias("det_recall"),
        accuracy.alias("class_accuracy"),
        region.alias("region_cer"),
        page.alias("page_cer"),
        tp.cast("long").alias("tp"),
        fp.cast("long").alias("fp"),
        fn.cast("long").alias("fn"),
        F.coalesce(cer_n, F.lit(0)).cast("long").alias("cer_regions"),
    ]


def metric_columns() -> list[Column]:
    """Aggregates of page rows: the composite and all its parts."""
    return metric_of(*[F.sum(c) for c in ("tp", "fp", "fn", "class_correct", "cer_sum", "cer_n")], F.avg("page_cer"))


def score(pages: DataFrame) -> DataFrame:
    """One row: the metric over page rows of ``score_pages``."""
    return pages.agg(*metric_columns())


def score_by_source(pages: DataFrame) -> DataFrame:
    """The metric of each source, and of all pages in the row whose source is null."""
    return pages.groupingSets([["source"], []], "source").agg(*metric_columns())


def score_if_complete(pages: DataFrame, n_target: int) -> DataFrame:
    """The metric once all target pages are there; else nulls beside the counts."""
    got = pages.agg(F.count("*").alias("completed_pages"), *metric_columns())
    done = F.col("completed_pages") >= n_target
    return got.select(
        "completed_pages", F.lit(n_target).cast("long").alias("target_pages"), done.alias("complete"),
        *[F.when(done, F.col(c)).alias(c) for c in got.columns if c != "completed_pages"]
    )


def type_events(pages: DataFrame, *by: str) -> DataFrame:
    """kind, type and cer of all that the report by type counts."""
    event = lambda kind, t, extra=F.lit(None).cast("double"): F.struct(F.lit(kind).alias("kind"), t.alias("type"), extra.alias("cer"))
    events = F.concat(
        F.transform("gt_types", lambda t: event("gt", t)),
        F.transform("pred_types", lambda t: event("pred", t)),
        F.transform("lost_gt", lambda t: event("fn", t)),
        F.transform("lost_pred", lambda t: event("fp", t)),
        F.transform("matches", lambda m: event("matched", m["gt_type"], m["cer"])),
        F.transform("matches", lambda m: event("matched_pred", m["pred_type"])),
        F.transform(F.filter("matches", lambda m: m["gt_type"] == m["pred_type"]), lambda m: event("correct", m["gt_type"])),
    )
    return pages.select(*by, F.explode(events).alias("e")).select(*by, "e.*")


def type_rates(n: dict[str, Column], region_cer: Column, cer_regions: Column) -> list[Column]:
    """The report by type from counts of its events by kind."""
    rate = lambda a, b: a / F.greatest(b, F.lit(1))
    return [
        n["gt"].alias("gt"),
        n["pred"].alias("pred"),
        n["matched"].alias("matched"),
        n["correct"].alias("class_correct"),
        n["fn"].alias("false_negative"),
        n["fp"].alias("false_positive"),
        rate(n["matched"], n["gt"]).alias("recall"),
        rate(n["matched"], n["matched"] + n["fp"]).alias("precision"),
        rate(n["matched_pred"], n["matched_pred"] + n["fp"]).alias("precision_pred"),
        rate(n["correct"], n["matched"]).alias("class_accuracy"),
        region_cer.alias("region_cer"),
        cer_regions.alias("cer_regions"),
    ]


EVENTS = ("gt", "pred", "matched", "correct", "fn", "fp", "matched_pred")


def by_type(pages: DataFrame, *by: str) -> DataFrame:
    """Counts and rates for each region type, within each value of the columns ``by``. ``precision`` sets matches by reference type against false ones by predicted type;
    ``precision_pred`` counts both by predicted type."""
    n = {k: F.count_if(F.col("kind") == k) for k in EVENTS}
    return type_events(pages, *by).groupBy(*by, "type").agg(*type_rates(n, F.avg("cer"), F.count("cer")))


def _scored_matches(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("matches").alias("m")).where("m.cer IS NOT NULL")


def by_length(pages: DataFrame) -> DataFrame:
    return _scored_matches(pages).groupBy(bin_label(F.col("m.chars"), LENGTH_BINS).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("m.cer").alias("region_cer")
    )


def by_height(pages: DataFrame) -> DataFrame:
    return _scored_matches(pages).groupBy(bin_label(F.col("m.height"), HEIGHT_BINS).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("m.cer").alias("region_cer")
    )


def confusion(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("matches").alias("m")).groupBy(
        F.col("m.gt_type").alias("gt"), F.col("m.pred_type").alias("pred")
    ).agg(F.count("*").alias("n"))


def page_errors(pages: DataFrame) -> DataFrame:
    """Errors per page; ``page_cer_diag`` is 0 for an empty reference page, where ``page_cer`` is null."""
    return pages.select(
        "image", "source", "page_cer", F.coalesce("page_cer", F.lit(0.0)).alias("page_cer_diag"), "gt_chars", "pred_chars",
        F.col("n_gt").alias("gt_regions"), F.col("n_pred").alias("pred_regions")
    )


def worst_pages(pages: DataFrame, n: int = 20) -> DataFrame:
    return page_errors(pages).orderBy(F.desc("page_cer_diag"), "image").limit(n)


def mean_cer_nonempty(pages: DataFrame) -> DataFrame:
    """Mean error of scored matches whose reference text isn't empty."""
    return _scored_matches(pages).where("m.chars > 0").agg(F.avg("m.cer").alias("eval_cer"), F.count("*").alias("n"))


def overlap_pairs(rows: DataFrame, iou_at: float = 0.80, ioa_at: float = 0.95) -> DataFrame:
    """image, i, j (i < j), both types, iou and ioa of pairs of a page's regions that reach either limit.

    Pages of many boxes list, by a sweep, the later boxes that each meets; on others each box is set against all later ones.
    """
    # one compiled row for each pair, of two boxes and their types alone: a page's array goes with its page and with no region or pair
    boxes = rows.select(
        "image", F.transform("regions", lambda r, i: F.struct(i.alias("i"), r["bbox"].alias("b"), r["type"].alias("type"))).alias("all")
    )
    every = F.col("all")
    swept = iou_at > 0 and ioa_at > 0
    after = lambda x: F.slice(every, x["i"] + 2, F.size(every))
    if swept:
        large = sweep.is_large(every, every, sweep.SMALL_AS_ROWS)
        boxes = boxes.withColumn("near", sweep.later_large(F.when(large, F.transform("all", lambda r: r["b"]))))
        near = F.col("near")
        later = lambda x: F.when(near.isNull(), after(x)).otherwise(F.transform(F.get(near, x["i"]), lambda j: F.get(every, j)))
    else:
        later = after
    first = boxes.select("image", F.explode(F.transform("all", lambda x: F.struct(x.alias("x"), later(x).alias("ys")))).alias("p"))
    pair = first.select("image", F.col("p.x").alias("x"), F.explode("p.ys").alias("y"))
    pair = pair.select("image", F.col("x.i").alias("i"), F.col("y.i").alias("j"), "x", "y")
    a, b = ([F.col(f"{side}.b")[n] for n in range(4)] for side in ("x", "y"))
    if swept:
        pair = pair.where((a[1] < b[3]) & (b[1] < a[3]) & (a[0] < b[2]) & (b[0] < a[2]))
    found = pair.select(
        "image", "i", "j", F.col("x.type").alias("type_i"), F.col("y.type").alias("type_j"), G.iou(a, b).alias("iou"), G.ioa_min(a, b).alias("ioa")
    )
    return found.where((F.col("iou") >= iou_at) | (F.col("ioa") >= ioa_at))


def overlap_count(rows: DataFrame, at: float = 0.80) -> DataFrame:
    """Pairs with plain overlap at or over the limit; none where the union is empty."""
    return overlap_pairs(rows, at, 2.0).agg(F.count_if(F.col("iou") >= at).alias("overlap_pairs"))


def diagnosis(metrics: DataFrame) -> DataFrame:
    """check, ok, observed: what the metric row says about where to work."""
    rules = [
        ("page_text_order", F.col("page_cer") <= F.col("region_cer") + 0.10, "page_cer"),
        ("detection_recall", F.col("det_recall") >= 0.70, "det_recall"),
        ("class_accuracy", F.col("class_accuracy") >= 0.80, "class_accuracy"),
        ("region_text", F.col("region_cer") <= 0.30, "region_cer"),
        ("composite_good", F.col("composite") >= 0.75, "composite"),
        ("composite_strong", F.col("composite") >= 0.85, "composite"),
    ]
    return metrics.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), F.col(c).alias("observed")) for n, ok, c in rules])).alias("r")
    ).select("r.*")


def reorder_like(sample: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """Exactly the sample's images in its order, missing ones empty."""
    got = predictions.select("image", "regions")
    return sample.select("image", order).join(got, "image", "left").withColumn(
        "regions", F.coalesce("regions", F.lit("[]") if dict(got.dtypes)["regions"] == "string" else F.array().cast(got.schema["regions"].dataType))
    ).orderBy(order)


def top_type_pairs(pairs: DataFrame, n: int = 12) -> DataFrame:
    """Most common ordered type pairs among overlaps; ties by first page and position."""
    seen = pairs.groupBy("type_i", "type_j").agg(F.count("*").alias("n"), F.min(F.struct("image", "i", "j")).alias("first"))
    return seen.orderBy(F.desc("n"), "first").limit(n).select("type_i", "type_j", "n")


def ranked_within(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)
