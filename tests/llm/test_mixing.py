from collections import Counter

import numpy as np
import pytest

from lumenloom.llm import mixing

ROWS = "row_id bigint, data_source string"
WEIGHTS = "source string, weight double, max_repeats int"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    positions = np.arange(size)
    out = mixing.permute(positions, np.full(size, size), np.full(size, 99))
    assert sorted(out) == list(range(size))
    if size > 60:
        assert (out != positions).mean() > 0.9
        assert (mixing.permute(positions, np.full(size, size), np.full(size, 98)) != out).mean() > 0.8


@pytest.mark.parametrize("region", [500_000_000, 60_000, 1])
def test_draws_keep_the_totals(region):
    planned = [1000, 0, 37, 25_000 if region == 1 else 250_000]
    shards = mixing.Shards(planned, 3, 10_000, region if region > 1 else 7_000)
    drawn = [shards.draw(k) for k in range(len(shards))]
    assert sum(c for c, _ in drawn).tolist() == planned
    used = np.zeros(4, np.int64)
    for counts, first in drawn:
        assert 0 < counts.sum() <= 10_000 and (first == used).all()
        used += counts


def test_draws_are_random_and_fair():
    shards = mixing.Shards([30_000, 70_000], 1, 100)
    share = np.array([shards.draw(k)[0][0] for k in range(len(shards))])
    assert share.mean() == pytest.approx(30)
    assert 3.5 < share.std() < 5.7  # of a binomial draw: 4.6
    assert [mixing.Shards([30_000, 70_000], 2, 100).draw(k)[0][0] for k in range(20)] != share[:20].tolist()


def data(spark):
    names = ["a_x"] * 600 + ["B-y "] * 300 + ["b_y"] * 60 + ["other"] * 40 + [None] * 5 + ["tiny"] * 2
    rows = spark.createDataFrame(list(enumerate(names)), ROWS)
    weights = spark.createDataFrame([("A_X", 0.2, 1), ("b_y", 0.6, 1), ("tiny", 0.1, 3), ("none", 0.1, 2)], WEIGHTS)
    return rows, weights


def test_plan_and_report(spark):
    plan = {r.source: r for r in mixing.mix_plan(*data(spark)).collect()}
    assert plan["b_y"].n_rows == 360 and plan["b_y"].total == 962
    assert {s for s, r in plan.items() if not r.feasible} == {"b_y", "tiny", "none"}
    assert sum(r.target for r in plan.values()) == 962
    report = {r.source: r for r in mixing.mix_report(mixing.mix_plan(*data(spark)), mixing.mix(*data(spark))).collect()}
    assert report["tiny"].actual == 6 and report["none"].actual == 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert sum(r.share_of_target for r in report.values()) == pytest.approx((193 + 360 + 6) / 962)
    assert report["tiny"].most_used == 3
    short = mixing.short_sources(mixing.mix_plan(*data(spark)), mixing.mix(*data(spark)))
    assert {r.source for r in short.collect()} == {"b_y", "tiny", "none"}


def test_mix_is_exact_and_bounded(spark):
    rows, weights = data(spark)
    plan = {r.source: r.planned for r in mixing.mix_plan(rows, weights).collect()}
    got = mixing.mix(rows, weights, slots=100).collect()
    assert Counter(r.source for r in got) == Counter({k: v for k, v in plan.items() if v})
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    for source, most in (("A_X", 1), ("b_y", 1), ("tiny", 3)):
        uses = Counter(r.row_id for r in got if r.source == source)
        assert max(uses.values()) <= most and max(uses.values()) - min(uses.values()) <= 1
    again = mixing.mix(rows.repartition(5), weights, slots=100).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_empty_tables(spark):
    rows, weights = data(spark)
    assert mixing.mix(rows.limit(0), weights).count() == 0
    assert mixing.mix(rows, weights.limit(0)).count() == 0
    assert all(not r.n_rows for r in mixing.mix_plan(rows.limit(0), weights).collect())


def test_slots_are_not_broadcast(spark):
    mixed = mixing.mix(*data(spark), slots=100)
    plan = mixed._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()
    assert mixed.count() == 559
    mixed.collect()
    assert "Broadcast" not in plan.toString() and "SortMergeJoin" in plan.toString()  # nor by the adaptive plan that ran
