"""Token budgets of prompts with images: patch grids, resized sizes, vision tokens and context limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch_limits(least: int, most: int, dynamic: bool, thumbnail: bool) -> tuple[int, int]:
    """Least and most patches of an image: 1 and 1 without dynamic sizes; a thumbnail adds one to a maximum above 1."""
    low, high = (least, most) if dynamic else (1, 1)
    return low, high + (1 if thumbnail and high != 1 else 0)


def patch_grid(width: Column, height: Column, least: int, most: int, image_size: int) -> Column:
    """The grid [columns, rows] of least..most cells that comes nearest to the image's aspect ratio.

    Of grids equally near, the one with most cells of which the image fills more
    than half is taken, else the one with the fewest cells.
    """
    cells = sorted({(i * j, i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most})
    options = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, i, j in cells])
    ratio = width / height
    distance = lambda o: F.abs(ratio - o["i"] / o["j"])
    nearest = F.filter(options, lambda o: distance(o) == F.array_min(F.transform(options, distance)))
    filled = F.filter(nearest, lambda o: width * height > 0.5 * image_size * image_size * o["n"])
    best = F.coalesce(F.try_element_at(filled, F.lit(-1)), nearest[0])
    return F.array(best["i"], best["j"])


def patch_count(grid: Column, thumbnail: bool) -> Column:
    """Cells of a grid, one more for a thumbnail if there are several."""
    n = grid[0] * grid[1]
    return F.when((n != 1) & F.lit(thumbnail), n + 1).otherwise(n)


def smart_size(width: Column, height: Column, factor: int, least_pixels: int, most_pixels: int, frames: int = 2) -> Column:
    """[width, height] in multiples of `factor` whose pixels, over all frames, are within the limits; null for sides below the factor or an aspect ratio above 200.

    Sides are rounded half to even; beyond the limits they are scaled and rounded down, or up.
    """
    w, h = width.cast("double"), height.cast("double")
    near = lambda v: F.bround(v / factor) * factor
    pixels = frames * near(w) * near(h)
    shrink, grow = F.sqrt(frames * w * h / most_pixels), F.sqrt(least_pixels / (frames * w * h))
    down = lambda v: F.greatest(F.lit(float(factor)), F.floor(v / shrink / factor) * factor)
    up = lambda v: F.ceil(v * grow / factor) * factor
    side = lambda v: F.when(pixels > most_pixels, down(v)).when(pixels < least_pixels, up(v)).otherwise(near(v)).cast("int")
    valid = (w >= factor) & (h >= factor) & (F.greatest(w, h) / F.least(w, h) <= 200)
    return F.when(valid, F.array(side(w), side(h)))


def merged_patches(size: Column, patch: int, merge: int) -> Column:
    """Vision tokens of a resized image: patches, merged in squares."""
    return F.floor(F.floor(size[0] / patch) * F.floor(size[1] / patch) / (merge * merge)).cast("int")


def available_tokens(prompt: Column, context: Column, margin: int = 0) -> Column:
    """Tokens left for an answer, at least 0; null without a context limit."""
    return F.when(context.isNotNull(), F.greatest(F.lit(0), context - prompt - margin))


def fits_context(prompt: Column, context: Column, new_tokens: Column, margin: int = 0) -> Column:
    """Whether prompt, answer and margin fit; true without a limit."""
    return F.coalesce(prompt + new_tokens + margin <= context, F.lit(True))


def context_overflow(text: Column) -> Column:
    """Whether an error text says that the context was exceeded; false for null."""
    # Phrases of such errors.
    phrases = ("context length", "maximum context", "max context", "input token", "too many tokens", "exceeds the model", "exceeded context")
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for phrase in phrases:
        found = found | low.contains(phrase)
    return found
