"""Features and labels of one pass: what is moved, the barriers by hand, rounding."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelspark import registry
from panelspark.operators import features as P
from panelspark.operators import rolling as R
from tests.conftest import SMALL


def test_features_and_labels_move_a_line_once(spark):
    plan = registry.QUERIES["ml1_labelled_features"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("MapInArrow") == 1


def test_barriers_by_hand(spark):
    """Closes that pass a barrier, stay within, don't move at all, or have few rows ahead; short symbols."""
    rng = np.random.default_rng(5)
    closes = {"a": np.exp(np.cumsum(rng.normal(0, 0.02, 90))), "b": np.ones(40), "c": np.exp(np.cumsum(rng.normal(0, 0.01, 22))), "d": np.array([1.0, 2.0])}
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows = [(s, day(i), float(x)) for s, c in closes.items() for i, x in enumerate(c)]
    got = {(r.symbol, r.trade_date): (r.label, r.realised) for r in R.triple_barrier(spark.createDataFrame(rows, "symbol string, trade_date date, close double")).collect()}
    want = {}
    for s, c in closes.items():
        ret = c[1:] / c[:-1] - 1
        for i in range(20, len(c) - 1):
            sigma = np.std(ret[i - 20 : i], ddof=1)
            if sigma > 0:
                moves = [x / c[i] - 1 for x in c[i + 1 : i + 11]]
                hits = [1 if m >= 1.5 * sigma else -1 if m <= -1.5 * sigma else 0 for m in moves]
                at = next((k for k, h in enumerate(hits) if h), len(hits) - 1)
                want[s, day(i)] = (hits[at], round(moves[at], 6))
    assert got == want and {k[0] for k in want} == {"a", "c"} and {v[0] for v in want.values()} == {-1, 0, 1}


def test_halves_go_away_from_zero(spark):
    xs = [0.0003125, -0.0003125, 0.0001875, 2.5e-6, -2.5e-6, 0.49e-6, 1e9, 123456789.1234565, -7.25, 1e300, float("inf"), float("nan"), None]
    want = [0.000313, -0.000313, 0.000188, 3e-6, -3e-6, 0.0, 1e9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    got = [r.x for r in R.rounded(df, 6, "x").collect()]
    old = [r.x for r in df.select(F.when(F.abs(F.col("x") * 1e6) < float("inf"), F.round(F.col("x") * 1e6) / 1e6).otherwise(F.col("x")).alias("x")).collect()]
    assert got[:7] == want and np.array_equal(np.array(got[:-1]), np.array(old[:-1]), equal_nan=True)
    assert np.array_equal(P.half_away(np.array(xs[:-1]), 6), np.array(got[:-1]), equal_nan=True) and got[-1] is None
