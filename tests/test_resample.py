"""Bootstrap, permutation test, GARCH and stress: brute force, recovery, planted signals."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import registry  # noqa: F401  plans import each other through it
from panelspark.operators import resample, stress
from panelspark.operators import rolling as R
from panelspark.plans.risk import strategy
from panelspark.sources.views import bars
from tests.conftest import SMALL

DAY = dt.date(2020, 1, 1)


def panel(spark, **series):
    rows = [(k, DAY + dt.timedelta(days=i), float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, close double")


def returns(spark, **series):
    return panel(spark, **series).withColumnRenamed("close", "ret")


def test_weighted_quantiles_are_those_of_the_repeated_values():
    r = np.random.default_rng(1)
    value, weight = np.sort(r.normal(size=50)), r.poisson(1, (50, 20))
    weight[:, 3] = 0
    got = resample.weighted_quantiles(value, weight, 0.05)
    want = [np.quantile(np.repeat(value, w), 0.05) if w.any() else np.nan for w in weight.T]
    assert np.allclose(got, want, equal_nan=True)


def test_bootstrap_interval_is_near_that_of_drawn_rows(spark):
    x = np.random.default_rng(2).standard_t(4, 1500) / 100
    got = {r.level: r for r in resample.tail_risk(returns(spark, a=x, b=x[:99], c=[*x[:200], float("nan")]), replicates=1000).where("symbol = 'a'").collect()}
    draws = np.random.default_rng(3).choice(x, (2000, len(x)))
    for level in (0.95, 0.99):
        low, high = np.quantile(-np.quantile(draws, 1 - level, axis=1), [0.025, 0.975])
        q = np.quantile(x, 1 - level)
        assert got[level].n == 1500 and got[level].value_at_risk == pytest.approx(-q) and got[level].shortfall == pytest.approx(-x[x <= q].mean())
        assert abs(got[level].low - low) < 0.1 * -q and abs(got[level].high - high) < 0.1 * -q
    assert got[0.99].low_confidence and not got[0.95].low_confidence


def test_bootstrap_needs_a_hundred_returns(spark):
    x = np.random.default_rng(2).normal(size=200)
    got = resample.tail_risk(returns(spark, short=x[:99], long=x[:100])).collect()
    assert {r.symbol for r in got} == {"long"} and len(got) == 2


def test_first_path_is_the_strategy_itself(spark):
    """The fold over paths gives the ratios of the windowed strategy."""
    s = strategy(spark, SMALL).where("ret IS NOT NULL").groupBy("symbol").agg((F.avg("strat_ret") / F.stddev_samp("strat_ret") * R.YEAR).alias("x"))
    want = {r.symbol: r.x or 0.0 for r in s.collect()}
    got = {r.symbol: r.sharpe for r in resample.permutation_test(bars(spark, SMALL), replicates=2).collect()}
    assert set(got) <= set(want) and len(got) > 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_permuted_paths_keep_returns_and_ends():
    close = np.exp(np.cumsum(np.random.default_rng(4).normal(0, 0.01, 101)))
    paths = resample.permuted_closes(close, 20, 30, 7)
    steps = np.sort(np.diff(np.log(paths), axis=0), axis=0)
    assert paths.shape == (101, 31) and np.allclose(steps, steps[:, :1]) and np.allclose(paths[-1], close[-1]) and np.allclose(paths[0], close[0])
    assert len({tuple(np.round(p, 9)) for p in paths.T}) > 25


def test_planted_and_random_signals(spark):
    r = np.random.default_rng(5)
    long_runs = np.repeat(np.tile([0.006, -0.006], 5), 150) + r.normal(0, 0.004, 1500)
    walks = {f"w{i}": 100 * np.exp(np.cumsum(r.normal(0, 0.01, 600))) for i in range(12)}
    got = {x.symbol: x.p for x in resample.permutation_test(panel(spark, runs=100 * np.exp(np.cumsum(long_runs)), two=[1, 2], **walks), replicates=99).collect()}
    assert got["runs"] <= 0.02 and "two" not in got
    random = [v for k, v in got.items() if k.startswith("w")]
    assert 0.25 < np.mean(random) < 0.8 and sum(v <= 0.05 for v in random) <= 3


def simulated(omega, alpha, beta, n, seed):
    z, h, out = np.random.default_rng(seed).normal(size=n), omega / (1 - alpha - beta), []
    for x in z:
        out.append(x * h**0.5)
        h = omega + alpha * out[-1] ** 2 + beta * h
    return np.array(out)


@pytest.mark.parametrize("alpha, beta", [(0.08, 0.9), (0.2, 0.6)])
def test_garch_recovers_what_was_simulated(alpha, beta):
    x = simulated(2e-6, alpha, beta, 20_000, 11)
    omega, a, b, ll, h = resample.garch_fit(x)
    assert abs(a - alpha) < 0.02 and abs(b - beta) < 0.02
    # no point of a fine grid around the truth is likelier by more than a little
    grid = np.array([(2e-6 * k, alpha + i / 200, beta + j / 200) for k in (0.8, 1, 1.2) for i in range(-4, 5) for j in range(-4, 5)])
    grid = grid[grid[:, 1] + grid[:, 2] < 0.9999]
    assert ll > resample.garch_likelihood(x * x, *grid.T)[0].max() - 0.2


def test_garch_of_symbols(spark):
    x = simulated(2e-6, 0.1, 0.85, 600, 3)
    got = {r.symbol: r for r in resample.garch(returns(spark, a=x, short=x[:249], flat=[0.0] * 300)).collect()}
    assert set(got) == {"a"} and got["a"].n == 600 and got["a"].next_vol > 0 and got["a"].persistence == pytest.approx(got["a"].alpha + got["a"].beta)


CASES = [("now", "2020-03-01", "2020-04-01", "2020-06-01", {"market": -0.3, "size": -0.1}), ("past", "2010-03-01", "2010-04-01", "2010-06-01", {"market": -0.5}), ("bare", "2010-03-01", "2010-04-01", "2010-06-01", {})]


def test_stress_has_a_row_for_every_pair(spark):
    """Replay with and without recovery, implied, insufficient."""
    fall = [100.0] * 65 + [80.0] * 30 + [90.0] * 100
    short = fall[:100]
    late = spark.createDataFrame([("late", dt.date(2021, 1, 1) + dt.timedelta(days=i), 10.0) for i in range(9)], "symbol string, trade_date date, close double")
    rows = panel(spark, fall=fall, short=short, none=fall).unionByName(late)
    loadings = spark.createDataFrame([("fall", "market", 1.2), ("fall", "size", 0.5), ("late", "market", 0.5), ("late", "size", None), ("short", "size", 1.0), ("short", "other", 9.0)], "symbol string, factor string, beta double")
    got = {(r.symbol, r.scenario): (r.method, r.drop_pct, r.recovery_pct) for r in stress.replay(rows, CASES, loadings).collect()}
    replayed, implied, nothing = "historical replay", "factor-implied", "insufficient history"
    assert got == {
        ("fall", "now"): (replayed, -20.0, 12.5), ("short", "now"): (replayed, -20.0, None), ("none", "now"): (replayed, -20.0, 12.5), ("late", "now"): (implied, -15.0, None),
        ("fall", "past"): (implied, -60.0, None), ("short", "past"): (nothing, None, None), ("none", "past"): (nothing, None, None), ("late", "past"): (implied, -25.0, None),
        **{(k, "bare"): (nothing, None, None) for k in ("fall", "short", "none", "late")},
    }


def test_stress_without_loadings_or_bars(spark):
    rows = panel(spark, a=[1.0, 2.0])
    assert {r.method for r in stress.replay(rows, CASES).collect()} == {"insufficient history"} and stress.replay(rows.limit(0), CASES).count() == 0
    assert isinstance(resample.composite_of(pd.DataFrame({"a": [1.0, 2.0]})), pd.DataFrame)
