"""How far images are scaled down before a prompt: overrides, budgets, dynamic and randomised factors. A size is [width, height]."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.geometry import cap_area, image_tokens, resize
from lumenloom.functions.values import finite_float

# Share of the area that a shrinking step leaves, most such steps, and halvings of a search.
SHRINK_AREA, MOST_SHRINKS, HALVINGS = 0.5, 4, 24


def sample_override(raw: Column) -> Column:
    """struct(factor, valid): a sample's own factor. None for null and empty; invalid unless it is a positive finite number."""
    text = raw.cast("string")
    none = text.isNull() | (text == "")
    number = finite_float(text)
    good = F.coalesce(number > 0, F.lit(False))
    return F.struct(F.when(~none & good, number).alias("factor"), (none | good).alias("valid"))


def presented_size(size: Column, factor: Column, most_area: Column) -> Column:
    """Size of an image as shown: scaled by the factor, then capped by area."""
    scaled = resize(F.get(size, F.lit(0)), F.get(size, F.lit(1)), factor)
    return F.transform(F.array(scaled), lambda s: cap_area(F.get(s, F.lit(0)), F.get(s, F.lit(1)), most_area))[0]


def presented_size_unless_one(size: Column, factor: Column, most_area: Column) -> Column:
    """As `presented_size`, but a factor of exactly 1 leaves the size to the cap alone, fractions and all."""
    own = cap_area(F.get(size, F.lit(0)), F.get(size, F.lit(1)), most_area)
    return F.when(factor == 1.0, own).otherwise(presented_size(size, factor, most_area))


def shrunk_size(size: Column, most_area: Column, steps: int = 1) -> Column:
    """Size after shrinking steps, each of which leaves SHRINK_AREA of the area, rounded anew every time."""
    for _ in range(steps):
        size = presented_size(size, F.lit(math.sqrt(SHRINK_AREA)), most_area)
    return size


def tokens_at(sizes: Column, factor: Column, most_area: Column) -> Column:
    """Image tokens of an array of sizes, shown at a factor."""
    return image_tokens(F.transform(sizes, lambda s: presented_size(s, factor, most_area)))


def pixels_at(sizes: Column, factor: Column, most_area: Column) -> Column:
    """Pixels of an array of sizes, shown at a factor."""
    shown = F.transform(sizes, lambda s: presented_size(s, factor, most_area))
    return F.aggregate(shown, F.lit(0).cast("bigint"), lambda acc, s: acc + F.get(s, F.lit(0)).cast("bigint") * F.get(s, F.lit(1)))


def _search(low: Column, high: Column, keep_low) -> Column:
    """Halves [low, high] HALVINGS times: the middle becomes the new low end where `keep_low(middle)` holds, else the high end."""
    start = F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        return F.transform(F.array(middle), lambda m: F.transform(F.array(keep_low(m)), lambda k: F.struct(F.when(k, m).otherwise(acc["lo"]).alias("lo"), F.when(k, acc["hi"]).otherwise(m).alias("hi")))[0])[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step)


def largest_within_tokens(sizes: Column, budget: Column, low: Column, high: Column, most_area: Column) -> Column:
    """The largest factor in [low, high] whose image tokens stay within the budget; null if not even `low` does."""
    fits = lambda f: tokens_at(sizes, f, most_area) <= budget
    found = _search(low, high, fits)["lo"]
    return F.when(fits(low), F.when(fits(high), high.cast("double")).otherwise(found))


def dynamic_factor(sizes: Column, configured: Column, least_pixels: Column, most_area: Column) -> Column:
    """The configured factor, at most 1, or the smallest larger one at which the images together have `least_pixels`.

    1 if not even that is enough. Without a bound or without images the
    configured factor holds.
    """
    base = F.least(configured.cast("double"), F.lit(1.0))
    enough = lambda f: pixels_at(sizes, f, most_area) >= least_pixels
    found = _search(base, F.lit(1.0), lambda f: ~enough(f))["hi"]
    unbound = (least_pixels <= 0) | (F.coalesce(F.size(sizes), F.lit(0)) <= 0)
    return F.when(unbound | enough(base), base).when(pixels_at(sizes, F.lit(1.0), most_area) <= least_pixels, F.lit(1.0)).otherwise(found)


def uniform(key: Column, seed: int) -> Column:
    """A pseudorandom number in [0, 1) that a key and a seed determine."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def randomised_factor(key: Column, seed: int, sizes: Column, budget: Column, low: Column, high: Column, most_area: Column) -> Column:
    """struct(factor, most): a factor drawn evenly from [low, the largest within the budget], and that largest one; both null if there is no room.

    `key` determines the draw, so a lost task repeats it.
    """
    most = F.when(F.size(sizes) > 0, F.when(budget > 0, largest_within_tokens(sizes, budget, low, high, most_area)))

    def drawn(m: Column) -> Column:
        top = F.least(high.cast("double"), m)
        factor = F.when(m.isNotNull() & (top >= low), F.when(F.abs(top - low) < 1e-8, low.cast("double")).otherwise(low + uniform(key, seed) * (top - low)))
        return F.struct(factor.alias("factor"), F.when(factor.isNotNull(), m).alias("most"))

    return F.transform(F.array(most), drawn)[0]


def effective_factor(sizes: Column, configured: Column, override: Column, drawn: Column | None, least_pixels: Column, most_area: Column, presented: Column | None = None) -> Column:
    """struct(actual, sampled, randomised, overridden): the factor a prompt's images are shown at.

    A sample's own factor wins over the drawn one (`randomised_factor`), which
    wins over the configured one; the result grows to `least_pixels`, but not
    beyond what the budget of a drawn factor allows. Images that are `presented`
    already keep the factor as it is.
    """
    nothing = F.lit(None).cast("double")
    factor, most = (drawn["factor"], drawn["most"]) if drawn is not None else (nothing, nothing)
    shown = F.coalesce(presented, F.lit(False)) if presented is not None else F.lit(False)
    random = override.isNull() & ~shown & factor.isNotNull()
    sampled = F.coalesce(override, F.when(random, factor), configured).cast("double")

    def settled(s: Column) -> Column:
        grown = dynamic_factor(sizes, s, least_pixels, most_area)
        actual = F.when(shown, s).when(random, F.least(grown, most)).otherwise(grown)
        return F.struct(actual.alias("actual"), s.alias("sampled"), random.alias("randomised"), override.isNotNull().alias("overridden"))

    return F.transform(F.array(sampled), settled)[0]


def fitted_prompt(sizes: Column, text_tokens: Column, limit: Column, most_area: Column, margin: int = 0) -> Column:
    """struct(steps, tokens, fits): shrinking steps (at most MOST_SHRINKS) until text and image tokens and the margin are within the limit."""
    tried = []
    now = sizes
    for steps in range(MOST_SHRINKS + 1):
        tokens = text_tokens + image_tokens(now)
        tried.append(F.struct(F.lit(steps).alias("steps"), tokens.alias("tokens"), (tokens + margin <= limit).alias("fits")))
        now = F.transform(now, lambda s: shrunk_size(s, most_area))
    all_ = F.array(*tried)
    good = F.get(F.filter(all_, lambda t: t["fits"]), F.lit(0))
    return F.when(F.size(sizes) > 0, F.coalesce(good, F.element_at(all_, -1))).otherwise(tried[0])
