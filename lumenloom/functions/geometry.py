"""Boxes and image sizes as column expressions. A box is array<double> [x1, y1, x2, y2], a size [width, height]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.values import bound


def _at(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def area(box: Column) -> Column:
    """Area of a box; negative extents count as 0, a null box has none."""
    return F.when(box.isNotNull(), F.greatest(F.lit(0.0), _at(box, 2) - _at(box, 0)) * F.greatest(F.lit(0.0), _at(box, 3) - _at(box, 1)))


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection; null if a box is null (least and greatest would skip it)."""
    width = F.least(_at(a, 2), _at(b, 2)) - F.greatest(_at(a, 0), _at(b, 0))
    height = F.least(_at(a, 3), _at(b, 3)) - F.greatest(_at(a, 1), _at(b, 1))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    inter = overlap(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def valid_box(box: Column) -> Column:
    """The box if it has four numbers and a positive extent, else null."""
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull() | F.isnan(v)) & (_at(box, 2) > _at(box, 0)) & (_at(box, 3) > _at(box, 1)), box)


def clamp(box: Column, width: Column, height: Column) -> Column:
    """The part of a box on the page, null if nothing is left."""
    zero = F.lit(0.0)
    cut = F.array(
        F.greatest(zero, F.least(width, _at(box, 0))), F.greatest(zero, F.least(height, _at(box, 1))),
        F.greatest(zero, F.least(width, _at(box, 2))), F.greatest(zero, F.least(height, _at(box, 3))),
    )
    return F.when((_at(cut, 0) < _at(cut, 2)) & (_at(cut, 1) < _at(cut, 3)), cut)


def clamp_to_pixels(box: Column, width: Column, height: Column) -> Column:
    """As `clamp`, coordinates first cut to whole pixels towards zero."""
    return clamp(F.transform(box, lambda v: v.cast("int").cast("double")), width, height)


def from_thousandths(box: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of an image as pixels, rounded half to even and clamped."""
    scale = [width, height, width, height]
    return clamp(F.array(*[F.bround(_at(box, i) * scale[i] / 1000.0).cast("double") for i in range(4)]), width, height)


def to_thousandths(box: Column, width: Column, height: Column) -> Column:
    """A pixel box in whole thousandths of the image, within 0..1000."""
    scale = [width, height, width, height]
    return F.array(*[F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(F.try_divide(_at(box, i) * 1000.0, scale[i])).cast("int"))) for i in range(4)])


def translate(box: Column, parent_box: Column, shown_width: Column, shown_height: Column) -> Column:
    """A box on a shown crop as a box on the original image, rounded half to even."""
    sx = F.try_divide(_at(parent_box, 2) - _at(parent_box, 0), shown_width)
    sy = F.try_divide(_at(parent_box, 3) - _at(parent_box, 1), shown_height)
    corner = [_at(parent_box, 0), _at(parent_box, 1)] * 2
    return F.array(*[F.bround(corner[i] + _at(box, i) * (sx if i % 2 == 0 else sy)).cast("double") for i in range(4)])


def within_tolerance(a: Column, b: Column, tolerance: int = 1) -> Column:
    """Whether all coordinates differ by at most the tolerance."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def union_area(boxes: Column) -> Column:
    """Exact area covered by an array of boxes, by coordinate compression; 0 for none.

    Cells between consecutive distinct coordinates are summed where a box covers
    them, all inside the JVM. Meant for arrays of tens of boxes.
    """
    good = F.filter(F.coalesce(boxes, F.array().cast("array<array<double>>")), lambda b: area(b) > 0)

    def cells(of: Column, low: int) -> Column:
        """The stretches between neighbouring distinct coordinates."""
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(of, lambda b: F.array(_at(b, low), _at(b, low + 2))))))
        return bound(edges, lambda e: F.zip_with(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))))

    def tall(over: Column, ys: Column) -> Column:
        return F.aggregate(ys, F.lit(0.0), lambda acc, y: acc + F.when(F.exists(over, lambda b: (_at(b, 1) <= y["lo"]) & (_at(b, 3) >= y["hi"])), y["hi"] - y["lo"]).otherwise(F.lit(0.0)))

    def swept(of: Column, xs: Column, ys: Column) -> Column:
        column = lambda x: F.filter(of, lambda b: (_at(b, 0) <= x["lo"]) & (_at(b, 2) >= x["hi"]))
        return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + bound(column(x), lambda over: tall(over, ys)) * (x["hi"] - x["lo"]))

    # Boxes and stretches are bound, else they would be worked out anew for every column of cells.
    return bound(good, lambda of: bound(F.struct(cells(of, 0).alias("xs"), cells(of, 1).alias("ys")), lambda c: swept(of, c["xs"], c["ys"])))


def resize(width: Column, height: Column, factor: Column) -> Column:
    """Size scaled by a factor, rounded half to even, at least 1 by 1."""
    side = lambda v: F.greatest(F.lit(1), F.bround(v * factor).cast("int"))
    return F.array(side(width), side(height))


def cap_area(width: Column, height: Column, most: Column) -> Column:
    """Size shrunk to an area, truncated, at least 1 by 1; unchanged if it fits or there is no limit."""
    size_ = width.cast("double") * height
    ratio = F.sqrt(F.try_divide(most.cast("double"), size_))
    side = lambda v: F.greatest(F.lit(1), (v * ratio).cast("int"))
    return F.when((size_ <= most) | (most <= 0), F.array(width.cast("int"), height.cast("int"))).otherwise(F.array(side(width), side(height)))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Longer over shorter side; infinite for a degenerate size."""
    short = F.least(width, height)
    return F.when(short > 0, F.greatest(width, height) / short).otherwise(F.lit(float("inf")))


def padded_size(width: Column, height: Column, most_ratio: float) -> Column:
    """Size after padding the shorter side up to the largest allowed aspect ratio."""
    short = lambda long: F.ceil(long / most_ratio).cast("int")
    return F.when(aspect_ratio(width, height) <= most_ratio, F.array(width.cast("int"), height.cast("int"))).otherwise(
        F.when(width >= height, F.array(width.cast("int"), short(width))).otherwise(F.array(short(height), height.cast("int")))
    )


def image_tokens(sizes: Column, patch: int = 32) -> Column:
    """Tokens of an array of sizes: patches of `patch` pixels, rounded up on each side."""
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, s: acc + F.ceil(F.get(s, F.lit(0)) / float(patch)) * F.ceil(F.get(s, F.lit(1)) / float(patch)))


def largest_factor(fits, steps: int = 24) -> Column:
    """The largest factor in 0..1 for which `fits(factor)` holds, by bisection with a fixed number of steps; 1 if it fits."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.struct(F.when(fits(mid), mid).otherwise(acc["lo"]).alias("lo"), F.when(fits(mid), acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return F.when(fits(F.lit(1.0)), F.lit(1.0)).otherwise(found["lo"])
