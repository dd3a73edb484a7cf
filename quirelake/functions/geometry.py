"""Box geometry as column expressions. A box is an array of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def area(b: Column) -> Column:
    """Area, 0 for inverted boxes."""
    return F.greatest(b[2] - b[0], _zero()) * F.greatest(b[3] - b[1], _zero())


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, _zero()) * F.greatest(h, _zero())


def iou_metric(a: Column, b: Column) -> Column:
    """Overlap as the page metric has it: plain signed areas below, and 0 unless both overlap and union are positive."""
    inter = intersection(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(_zero())


def iou(a: Column, b: Column) -> Column:
    """Overlap as post-processing has it: clamped areas, union of at least 1e-9."""
    inter = intersection(a, b)
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-9))


def ioa_min(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))


def normalized_box(b: Column, width: Column, height: Column) -> Column:
    """Centre and size relative to the image; null under 5 pixels. Boxes wholly within the unit square whose last two are under a half pass."""
    unit = F.forall(b, lambda v: (v >= 0) & (v <= 1)) & (b[2] < 0.5) & (b[3] < 0.5)
    x1, x2 = F.greatest(F.least(b[0], b[2]), _zero()), F.least(F.greatest(b[0], b[2]), width)
    y1, y2 = F.greatest(F.least(b[1], b[3]), _zero()), F.least(F.greatest(b[1], b[3]), height)
    fit = (x2 - x1 >= 5) & (y2 - y1 >= 5)
    made = F.array((x1 + x2) / (width * 2), (y1 + y2) / (height * 2), (x2 - x1) / width, (y2 - y1) / height)
    return F.when(F.size(b) != 4, None).when(unit, b).when(fit, made)


def clamped(b: Column, width: Column, height: Column) -> Column:
    def within(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0)), top)

    return F.array(within(b[0], width), within(b[1], height), within(b[2], width), within(b[3], height))


def crop_rect(b: Column, width: Column, height: Column, pad: int = 4, jitter: int = 0, seed: Column | int = 0) -> Column:
    """Padded and clipped crop; null where it is under 5 pixels (a blank crop).

    jitter: each coordinate is moved by up to so many pixels before that, by a hash of the box, the coordinate and ``seed``.
    """
    seed = F.lit(seed) if isinstance(seed, int) else seed
    move = (lambda v, k: F.pmod(F.xxhash64(b, k, seed), F.lit(2 * jitter + 1)).cast("int") - jitter) if jitter else (lambda v, k: F.lit(0))
    c = F.transform(b, lambda v, k: v.cast("int") + move(v, k))
    r = F.array(F.greatest(c[0] - pad, F.lit(0)), F.greatest(c[1] - pad, F.lit(0)), F.least(c[2] + pad, width), F.least(c[3] + pad, height))
    return F.when((r[2] - r[0] >= 5) & (r[3] - r[1] >= 5), r)


def resized(width: Column, height: Column, max_height: int = 128, min_width: int = 32, max_width: int = 1920) -> Column:
    """Size after the height limit."""
    w = F.greatest(F.lit(min_width), F.least(F.lit(max_width), F.bround(width * max_height / height).cast("int")))
    return F.when(
        height <= max_height, F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))
    ).otherwise(F.struct(w.alias("width"), F.lit(max_height).alias("height")))


def out_of_bounds(b: Column, width: Column, height: Column) -> Column:
    return (b[0] < 0) | (b[1] < 0) | (b[2] > width) | (b[3] > height)


def region_key(b: Column, kind: Column) -> Column:
    return F.concat(F.array_join(F.transform(b, lambda v: v.cast("int").cast("string")), ","), F.lit("|"), kind)


def reading_order(regions: Column, scorable) -> Column:
    """Regions reordered: scorable ones by 15-pixel row, then centre x, then position; others after them as they were."""
    keyed = F.transform(
        regions,
        lambda r, i: F.struct(
            (~scorable(r)).alias("late"),
            F.when(scorable(r), F.floor((r["bbox"][1] + r["bbox"][3]) / 2 / 15)).otherwise(0).alias("row"),
            F.when(scorable(r), (r["bbox"][0] + r["bbox"][2]) / 2).otherwise(0.0).alias("x"),
            i.alias("i"),
            r.alias("r"),
        ),
    )
    order = F.array_sort(F.transform(keyed, lambda k: F.struct(k["late"].alias("late"), k["row"].alias("row"), k["x"].alias("x"), k["i"].alias("i"))))
    return F.transform(order, lambda o: F.element_at(regions, o["i"] + 1))
