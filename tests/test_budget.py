"""Token budgets and sample predicates."""

import math

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import budget as B
from lumenloom.functions import samples as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def nearest(w, h, low, high, size):
    best, grid = math.inf, (1, 1)
    for n, i, j in sorted({(i * j, i, j) for i in range(1, high + 1) for j in range(1, high + 1) if low <= i * j <= high}):
        d = abs(w / h - i / j)
        if d < best or (d == best and w * h > 0.5 * size * size * n):
            best, grid = d, (i, j)
    return list(grid)


@pytest.mark.parametrize("w, h", [(100, 100), (2000, 1000), (3000, 3000), (100, 900), (896, 448), (1792, 896), (641, 480)])
def test_patch_grid(spark, w, h):
    assert one(spark, B.patch_grid(F.lit(w), F.lit(h), 1, 12, 448)) == nearest(w, h, 1, 12, 448)


def test_sizes(spark):
    assert B.patch_limits(1, 12, True, True) == (1, 13) and B.patch_limits(1, 12, False, True) == (1, 1)
    assert one(spark, B.patch_count(F.array(F.lit(2), F.lit(3)), True)) == 7
    assert one(spark, B.patch_count(F.array(F.lit(1), F.lit(1)), True)) == 1
    assert one(spark, B.smart_size(F.lit(280), F.lit(140), 28, 112 * 112, 10**7)) == [280, 140]
    assert one(spark, B.smart_size(F.lit(5000), F.lit(5000), 28, 112 * 112, 28 * 28 * 2 * 100)) == [280, 280]
    assert one(spark, B.smart_size(F.lit(28), F.lit(28), 28, 112 * 112, 10**7)) == [84, 84]
    assert one(spark, B.smart_size(F.lit(10), F.lit(100), 28, 1, 10**7)) is None
    assert one(spark, B.merged_patches(F.array(F.lit(280), F.lit(140)), 14, 2)) == 50
    assert one(spark, B.available_tokens(F.lit(10), F.lit(8))) == 0
    assert one(spark, B.fits_context(F.lit(10), F.lit(None).cast("int"), F.lit(5)))
    assert one(spark, B.context_overflow(F.lit("Maximum Context of 5"))) and not one(spark, B.context_overflow(F.lit(None).cast("string")))


def test_samples(spark):
    score = lambda **v: F.create_map(*[x for k, y in v.items() for x in (F.lit(k), F.lit(float(y)))])
    none = F.array().cast("array<string>")
    assert one(spark, S.accuracy(score(reward=0.5, score="nan"))) == 0.5
    assert one(spark, S.is_valid(score(score=1), none)) and not one(spark, S.is_valid(score(score=1, compute_score_success=0), none))
    assert not one(spark, S.is_valid(score(score=1), F.array(F.lit("x"))))
    assert one(spark, S.reward_is_right(F.lit(None).cast("double"), F.lit(1.0))) and not one(spark, S.reward_is_right(F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert one(spark, S.response_tokens(F.lit(None).cast("int"), F.lit(3), F.lit(None).cast("int"))) == 3
    assert one(spark, S.first_positive(F.lit("x"), F.lit("0"), F.lit("7"))) == 7
    assert not one(spark, S.needs_judging(score(score=1), F.lit(False))) and one(spark, S.needs_judging(score(score=1), F.lit(None).cast("boolean"), True))
    assert one(spark, S.reasons_of(F.lit('["a", "", null]'))) == ["a"] and one(spark, S.reasons_of(F.lit("b c"))) == ["b c"]
