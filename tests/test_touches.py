"""Touches of dated levels: by hand, and by brute force on random bars."""

import datetime as dt

import numpy as np
import pytest

from panelspark import registry  # noqa: F401  plans import each other through it
from panelspark.operators import touches

DAY = dt.date(2020, 1, 1)
BARS = "symbol string, trade_date date, open double, high double, low double, close double, volume bigint"
LEVELS = "symbol string, as_of date, call_wall double, put_wall double, gamma_flip double"


def frame(spark, symbol, rows):
    """rows: (high, low, close) a day."""
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(days=i), float(c), float(h), float(lo), float(c), 1) for i, (h, lo, c) in enumerate(rows)], BARS)


def by_kind(df):
    return {r.level_type: r for r in df.collect()}


def test_each_level_is_touched(spark):
    flat = [(100.5, 99.5, 100.0)] * 7
    rows = [*flat, (109.5, 100, 108.0), (108, 104, 105.0), *flat, (100, 90.5, 92.0), (97, 92, 96.0), *flat]
    bars = frame(spark, "a", rows)
    levels = spark.createDataFrame([("a", DAY - dt.timedelta(days=1), 110.0, 90.0, 106.0)], LEVELS)
    got = by_kind(touches.study(bars, levels))
    assert (got["call_wall"].touches, got["call_wall"].reversals) == (1, 1) and got["call_wall"].mean_move == pytest.approx(105 / 108 - 1, abs=1e-6)
    assert (got["put_wall"].touches, got["put_wall"].reversals) == (1, 1) and got["put_wall"].mean_move == pytest.approx(96 / 92 - 1, abs=1e-6)
    assert got["gamma_flip"].touches == 2 and got["gamma_flip"].reversals == 1  # up and back; the five closes before the way up are flat
    assert all(r.z == 0 and r.p == 0.5 and not r.significant for r in got.values())


def test_levels_hold_from_the_day_after_their_snapshot(spark):
    bars = frame(spark, "a", [(100, 100, 100.0), (110, 100, 100.0), (110, 100, 100.0), (110, 100, 100.0), (100, 100, 100.0)])
    one = lambda day, wall: ("a", DAY + dt.timedelta(days=day), wall, None, None)
    count = lambda *rows: touches.study(bars, spark.createDataFrame(list(rows), LEVELS)).collect()
    assert [r.touches for r in count(one(0, 110.0))] == [3]
    assert [r.touches for r in count(one(1, 110.0))] == [2]  # not on the snapshot's own day
    assert [r.touches for r in count(one(0, 110.0), one(2, 150.0))] == [2]
    assert count(one(9, 110.0)) == [] and count(("b", DAY, 110.0, None, None)) == []
    assert touches.study(bars.limit(0), spark.createDataFrame([one(0, 110.0)], LEVELS)).count() == 0


def test_against_brute_force(spark):
    r = np.random.default_rng(6)
    n = 300
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n)))
    high, low = close * (1 + np.abs(r.normal(0, 0.01, n))), close * (1 - np.abs(r.normal(0, 0.01, n)))
    snaps = [(i, *(float(close[i] * k) for k in (1.03, 0.97, 1.0))) for i in range(0, n, 40)]
    got = by_kind(touches.study(frame(spark, "a", list(zip(high.tolist(), low.tolist(), close.tolist()))), spark.createDataFrame([("a", DAY + dt.timedelta(days=i), *v) for i, *v in snaps], LEVELS)))
    want = {k: [0, 0] for k in touches.KINDS}
    for i in range(1, n - 1):
        held = [v for j, *v in snaps if j < i]
        if not held:
            continue
        call, put, flip = held[-1]
        if close[i - 1] < call and high[i] >= call * 0.99:
            want["call_wall"][0] += 1
            want["call_wall"][1] += close[i + 1] < close[i]
        if close[i - 1] > put and low[i] <= put * 1.01:
            want["put_wall"][0] += 1
            want["put_wall"][1] += close[i + 1] > close[i]
        if (close[i - 1] - flip) * (close[i] - flip) < 0:
            want["gamma_flip"][0] += 1
            want["gamma_flip"][1] += i >= 5 and i + 5 < n and np.std(close[i : i + 5]) > np.std(close[i - 5 : i])
    assert {k: [v.touches, v.reversals] for k, v in got.items()} == {k: list(map(int, v)) for k, v in want.items()}
    drawn = [x.level for x in touches.null_levels(frame(spark, "a", list(zip(high.tolist(), low.tolist(), close.tolist()))), 25).first().drawn]
    rates = []
    for level in drawn:
        hit = [i for i in range(1, n - 1) if close[i - 1] < level and high[i] >= level * 0.99]
        if len(hit) >= 3:
            rates.append(np.mean([close[i + 1] < close[i] for i in hit]))
    assert got["call_wall"].baseline == pytest.approx(np.mean(rates), abs=1e-6) and got["call_wall"].spread == pytest.approx(np.std(rates), abs=1e-6)
