"""The signals' evaluation by date and their one-pass panel, against windows, loops and the operators they join."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import registry  # noqa: F401  plans import each other through it
from panelspark.operators import rolling as R
from panelspark.operators import signals
from panelspark.sources.views import bars, bench, bench_returns
from tests.conftest import SMALL

SCHEMA = "signal string, symbol string, trade_date date, value double, f1 double, f5 double"


def panel(spark):
    """Ties, gaps, a thin date, a constant signal, not-a-number."""
    r, rows = np.random.default_rng(3), []
    for d in range(6):
        for s in range(19 if d == 2 else 9 if d == 4 else 45 + d):
            for k in ("a", "b", "c"):
                value = {"a": round(float(r.normal()), 1), "b": 1.0, "c": float(r.normal())}[k]
                value = None if r.random() < 0.05 and k == "a" and d != 2 else math.nan if k == "c" and s in (3, 30) else value
                rows.append((k, f"s{s * 7 % 60:02d}", dt.date(2020, 1, 1 + d), value, None if s % 11 == d else round(float(r.normal()), 1), float(r.normal())))
    return spark.createDataFrame(rows, SCHEMA)


def by_hand(p, forward):
    ic, weights = {}, {}
    for (k, day), g in p.groupby(["signal", "trade_date"]):
        g = g[g.there & g[forward].notna()].sort_values("symbol")
        key = g.value.fillna(np.inf)
        x, y = key.rank(), g[forward].rank()
        s = x.std(ddof=0) * y.std(ddof=0)
        ic[k, day] = (len(g), (np.cov(x, y, ddof=0)[0, 1] / s if s > 0 else 0.0) if len(g) >= 10 else None)
        if len(g) >= 20:
            g = g.loc[key.sort_values(kind="stable").index]
            bucket = np.maximum(1, np.ceil(np.arange(len(g)) * 10 / (len(g) - 1)))
            low, high = g[bucket == 1], g[bucket == 10]
            w = {**dict.fromkeys(low.symbol, -1 / len(low)), **dict.fromkeys(high.symbol, 1 / len(high))}
            weights.setdefault(k, []).append((day, high[forward].mean() - low[forward].mean(), w))
    spread = {}
    for k, days in weights.items():
        before = {}
        for day, x, w in days:
            spread[k, day] = (x, sum(abs(w.get(s, 0) - before.get(s, 0)) for s in {*w, *before}) / 2)
            before = w
    return ic, spread


def test_daily_by_hand(spark):
    rows = panel(spark)
    p = pd.DataFrame([r.asDict() | {"there": r.value is not None} for r in rows.collect()])
    day = signals.daily(rows, ["f1", "f5"])
    got = {(r.signal, r.trade_date): r for r in day.collect()}
    for i, f in enumerate(("f1", "f5")):
        ic, spread = by_hand(p, f)
        assert set(got) == set(ic)
        for k, (n, x) in ic.items():
            assert got[k].n[i] == n and (got[k].ic[i] == pytest.approx(x, abs=1e-12) if x is not None else got[k].ic[i] is None)
        if i == 0:
            found = {(r.signal, r.trade_date): (r.spread, r.turnover) for r in signals.spreads(day).collect()}
            assert set(found) == set(spread) and len({d for _, d in spread}) == 4
            assert all(found[k] == pytest.approx(spread[k], abs=1e-12) for k in spread)


def test_a_column_a_signal_is_a_row_a_signal(spark):
    long = panel(spark).where("value IS NOT NULL")
    wide = long.groupBy("symbol", "trade_date").agg(*[F.max(F.when(F.col("signal") == k, F.col("value"))).alias(k) for k in "abc"], F.first("f1").alias("f1"))
    long = wide.unpivot(["symbol", "trade_date", "f1"], list("abc"), "signal", "value").where("value IS NOT NULL")
    rows = lambda df: sorted(tuple(r.asDict().items()) for r in df.select("signal", "trade_date", "n", "ic", "spread", "low", "high").withColumns({c: F.col(c).cast("string") for c in ("n", "ic", "low", "high")}).collect())
    assert rows(signals.daily(wide, ["f1"], ("a", "b", "c"))) == rows(signals.daily(long, ["f1"]))


def test_panel_is_that_of_the_operators(spark):
    """One pass, with closes of zero (no return for two rows), gives what their join gives; and it moves the bars once by symbol."""
    b, m = bars(spark, SMALL), bench_returns(bench(spark, SMALL))
    b = b.withColumn("close", F.when((F.col("symbol") == "S000001") & (F.dayofmonth("trade_date") == 9), 0.0).otherwise(F.col("close")))
    got = R.signal_panel(b, m)
    want = R.price_signals(b).join(R.residual_reversal(b, m), ["symbol", "trade_date"], "left").join(R.forward_returns(b), ["symbol", "trade_date"])
    key = lambda df: {(r.symbol, r.trade_date): [r[c] for c in got.columns[2:]] for r in df.collect()}
    a, c = key(got), key(want)
    assert set(a) == set(c) and sum(v[3] is not None for v in a.values()) > 10
    for k in c:
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1.1e-6)) for x, y in zip(a[k], c[k])), (k, a[k], c[k])
    plan = R.signal_panel(b, m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 2 and "SortMergeJoin" not in plan
