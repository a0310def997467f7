import datetime as dt
import time

import numpy as np
import pytest

from tidemark.operators import causality, changepoints, outliers, quality, series


def months(n, start=(2020, 1)):
    y, m = start
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


def frame(spark, values, key="a", start=(2020, 1)):
    return spark.createDataFrame([(key, p, v if v is None else float(v)) for p, v in zip(months(len(values), start), values, strict=True)], "k string, period date, value double")


def test_changes_and_zero_division(spark):
    got = series.change(frame(spark, [100, 0, 50, None]), ["k"]).orderBy("period").collect()
    assert [r.change_pct for r in got] == [None, -100.0, None, None]


def test_decumulate_takes_the_first_row_present(spark):
    got = series.decumulate(frame(spark, [10, 30, 60], start=(2020, 11)), ["k"]).orderBy("period").collect()
    assert [r.value_flow for r in got] == [10.0, 20.0, 60.0]


def test_index_uses_next_period_and_refuses_zero(spark):
    df = frame(spark, [None, 50, 100])
    assert [r["index"] for r in series.index_to_base(df, ["k"], "2020-01-01").orderBy("period").collect()] == [None, 100.0, 200.0]
    assert {r["index"] for r in series.index_to_base(frame(spark, [0, 5]), ["k"]).collect()} == {None}


def test_monthly_rules(spark):
    rows = [("s", dt.date(2020, 1, d), v) for d, v in ((1, 1.0), (2, None), (3, 5.0))]
    df = spark.createDataFrame(rows, "k string, day date, value double")
    for rule, want in (("last", 5.0), ("avg", 3.0), ("sum", 6.0)):
        (r,) = series.aggregate_monthly(df, ["k"], "day", "value", rule).collect()
        assert (r.value, r.n_native, r.value_sum) == (want, 2, 6.0 if rule == "sum" else None)


def test_growth_across_a_gap_is_per_period(spark):
    df = frame(spark, [100, 110, 121, 133.1, 146.41]).where("period <> '2020-03-01'")
    got = [r.growth_pct for r in series.log_growth(df, ["k"]).orderBy("period").collect()]
    assert got[0] is None and np.allclose(got[1:], 100 * np.log(1.1))
    (gap,) = series.find_gaps(df, ["k"]).collect()
    assert gap.missing_periods == 1


def test_outlier_needs_both_checks_and_is_classified(spark):
    rng = np.random.default_rng(4)
    x = 100 + rng.normal(0, 1, 36)
    spike, shift = x.copy(), x.copy()
    spike[20] = 160
    shift[20:] += 60
    for values, kind in ((spike, "spike"), (shift, "regime_start")):
        found = outliers.classify(outliers.score(frame(spark, values), ["k"], on="level"), ["k"]).collect()
        assert (months(36)[20], kind) in [(r.period, r.kind) for r in found]
    last = x.copy()
    last[35] = 200
    assert outliers.classify(outliers.score(frame(spark, last), ["k"], on="level"), ["k"]).collect()[-1].kind == "undetermined"
    with pytest.raises(ValueError):
        outliers.score(frame(spark, x), ["k"], window=2)


def test_change_point_of_a_level_shift_and_of_noise(spark):
    rng = np.random.default_rng(1)
    shifted = np.where(np.arange(60) < 30, 100, 130) + rng.normal(0, 1, 60)
    noise = np.random.default_rng(2).normal(0, 1, 60) + 50
    df = frame(spark, shifted, "shift", (2021, 1)).union(frame(spark, noise, "noise", (2021, 1)))
    (r,) = changepoints.change_points(df, ["k"]).collect()
    assert (r.k, r.period, r.direction, r.confidence) == ("shift", dt.date(2023, 7, 1), "up", "solid")
    assert abs(r.shift - 30) < 2


def test_partition_is_optimal_against_all_cuts():
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(0, 0.3, 9), rng.normal(2, 0.3, 8), rng.normal(0, 0.3, 7)])
    cost = lambda ends: sum(((z[a:b] - z[a:b].mean()) ** 2).sum() for a, b in zip([0, *ends], [*ends, len(z)], strict=True)) + 1.0 * len(ends)
    best = min([()] + [(i,) for i in range(4, 21)] + [(i, j) for i in range(4, 21) for j in range(i + 4, 21)], key=cost)
    assert changepoints.partition(z, 1.0, 4)[:-1] == list(best)


def test_granger_finds_the_direction(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 120)
    y = np.concatenate([[0, 0], 0.9 * x[:-2]]) + rng.normal(0, 0.3, 120)
    df = spark.createDataFrame([("p", p, float(a), float(b)) for p, a, b in zip(months(120, (2010, 1)), y, x, strict=True)], "k string, period date, y double, x double")
    (r,) = causality.granger_pairs(df, ["k"], "y", "x").collect()
    assert r.verdict == "predictor->target" and r.lag >= 2 and not r.differenced and r.effect_forward > 0


def test_pairs_that_cannot_be_tested_say_why(spark):
    rows = [("short", i, float(i), float(i)) for i in range(5)] + [("still", i, 1.0, float(i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, period int, y double, x double")
    assert {r.k: (r.n_obs, r.verdict, r.lag, r.differenced) for r in causality.granger_pairs(df, ["k"], "y", "x").collect()} == {"short": (5, None, None, None), "still": (40, None, None, None)}
    assert {r.k: r.reason[:10] for r in causality.granger_pairs(df, ["k"], "y", "x").collect()} == {"short": "5 aligned ", "still": "the target"}


def test_tails_against_known_values():
    assert abs(causality.f_tail(4.0, 2, 20) - 0.03457) < 1e-4
    assert abs(causality.f_tail(1.0, 5, 5) - 0.5) < 1e-9
    assert abs(causality.unit_root_p(-2.86) - 0.05) < 0.002
    assert causality.unit_root_p(5) == 1.0


def test_checks_raise_with_what_failed(spark):
    df = frame(spark, [1, 2, 3]).where("period <> '2020-02-01'")
    missing = quality.missing_periods(df, ["k"])
    assert [r.period for r in missing.collect()] == [dt.date(2020, 2, 1)]
    with pytest.raises(quality.ValidationError, match="continuity"):
        quality.enforce("continuity", missing)
    quality.enforce("continuity", missing.limit(0))


def test_formula_differences(spark):
    df = spark.createDataFrame([(1, 30.0), (2, 10.0), (3, 20.0), (4, 99.0)], "position int, value double").withColumn("m", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    terms = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (4, 1, 2), (4, -1, 3)], "position int, sign int, term_position int")
    (bad,) = quality.formula_differences(df, ["m"], terms, "position", "value").collect()
    assert (bad.position, bad.expected) == (4, -10.0)


def plain_partition(z, penalty, least):
    """Segment ends by trying every start for every end."""
    n, s, q = len(z), np.concatenate([[0], np.cumsum(z)]), np.concatenate([[0], np.cumsum(z * z)])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for end in range(least, n + 1):
        starts = np.arange(end - least + 1)
        cost = best[starts] + q[end] - q[starts] - (s[end] - s[starts]) ** 2 / (end - starts) + penalty
        back[end], best[end] = int(cost.argmin()), cost.min()
    ends = []
    while n > 0:
        ends.append(n)
        n = back[n]
    return ends[::-1]


def test_pruned_partitions_are_those_of_all_starts():
    rng = np.random.default_rng(3)
    for i in range(250):
        n, least = int(rng.integers(8, 250)), int(rng.integers(1, 12))
        z = rng.normal(size=n) * rng.choice([0.1, 1]) + np.repeat(rng.normal(size=n) * 3, rng.integers(1, 60, n))[:n]
        z = np.round(z) if i % 5 == 0 else np.cumsum(z) if i % 7 == 0 else np.zeros(n) if i == 1 else z
        penalties = [m * np.log(n) * float(rng.choice([0.2, 1, 2])) for m in (3, 2, 1)]
        if n >= 2 * least:
            assert changepoints.partitions(z, penalties, least) == [plain_partition(z, p, least) for p in penalties]


def test_partitions_of_a_hundred_thousand_points_take_seconds():
    rng = np.random.default_rng(4)
    z = rng.normal(size=100_000)  # without a break no start is ruled out by costs alone
    began = time.perf_counter()
    ends = changepoints.partitions(z, [m * np.log(len(z)) for m in (3, 2, 1)], 13)
    assert time.perf_counter() - began < 60 and [e[-1] for e in ends] == [100_000] * 3
