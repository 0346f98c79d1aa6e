"""Operators on hand-built frames: known values, invariants, recovery, plan shapes."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf
from panelspark.operators import cross, options, rolling, solve, studies
from panelspark.operators.asof import asof, nearest
from panelspark.sources import payloads, views

DAY = dt.date(2022, 1, 3)
BAR = "symbol string, trade_date date, open double, high double, low double, close double, volume bigint"


def bars_of(spark, **closes):
    rows = [(s, DAY + dt.timedelta(i), c, c * 1.01, c * 0.99, c, 1000) for s, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, BAR)


def walk(seed, n=300, drift=0.0005, sd=0.012):
    r, out = random.Random(seed), [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(r.gauss(drift, sd)))
    return out


def test_forward_returns(spark):
    b = rolling.forward_returns(bars_of(spark, A=[100.0, 105.0, 110.0, 99.0, 120.0]), (1, 2)).orderBy("trade_date").collect()
    assert (b[0].fwd_1, b[0].fwd_2, b[2].fwd_1, b[4].fwd_1) == (0.05, 0.1, -0.1, None)


def test_short_histories(spark):
    b = bars_of(spark, A=[100.0], B=[100.0, 101.0])
    got = {r.symbol: r for r in rolling.vol_term_structure(b).collect()}
    assert got["A"].vol_5d is None and len(got) == 2


def test_drawdown_is_never_positive(spark):
    d = rolling.drawdowns(bars_of(spark, A=walk(1), B=walk(2)))
    assert d.where("drawdown > 0").count() == 0


def test_correlation_of_a_series_with_itself(spark):
    g = cross.pairwise(bars_of(spark, A=walk(1), B=walk(2)))
    rows = {(r.a, r.b): r.correlation for r in g.collect()}
    assert rows["A", "A"] == rows["B", "B"] == 1.0 and abs(rows["A", "B"]) < 0.3 and ("B", "A") not in rows


@pytest.mark.parametrize("seed", range(3))
def test_position_equals_a_loop(spark, seed):
    rows = rolling.rsi(bars_of(spark, A=walk(seed, 400, 0, 0.03))).withColumns({"s200": rolling.full(F.avg("close").over(rolling.last(200)), "close", 200), "s5": rolling.full(F.avg("close").over(rolling.last(5)), "close", 5)})
    state, want = 0, []
    for r in rows.orderBy("trade_date").collect():
        if r.rn <= 200:
            want.append(0)
            continue
        enter, leave = r.close > r.s200 and r.rsi < 15, r.rsi > 70 or r.close > r.s5
        state = (0 if leave else 1) if state else (1 if enter else 0)
        want.append(state)
    got = [r.state for r in rolling.rsi_position(bars_of(spark, A=walk(seed, 400, 0, 0.03))).orderBy("trade_date").collect()]
    assert got == want and sum(want) > 0


def test_percentiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (10, 20, 30, 40, 50)] + [("g", None)], "k string, v double")
    p = lambda m: [r[0] for r in df.select(cross.percentile_rank(df, "v", ["k"], m).alias("p"), "v").where("v IS NOT NULL").orderBy("v").collect()]
    assert p("mean") == [10, 30, 50, 70, 90] and p("rank") == [20, 40, 60, 80, 100] and p("peer") == [0, 25, 50, 75, 100]


def test_rank_ic_of_a_planted_signal(spark):
    r = random.Random(7)
    rows = [(str(k), DAY + dt.timedelta(d), s, 0.25 * s + r.gauss(0, 0.97)) for d in range(60) for k in range(50) for s in [r.gauss(0, 1)]]
    ic = cross.rank_ic(spark.createDataFrame(rows, "symbol string, trade_date date, sig double, f double"), "sig", "f")
    assert abs(ic.agg(F.avg("ic")).first()[0] - 0.24) < 0.06
    nw = cross.newey_west(ic.withColumn("one", F.lit(1)), "ic", ["one"], "trade_date").first()
    assert nw.n == 60 and nw.t > 2


def test_buckets_are_even(spark):
    rows = [(f"{k:02d}", DAY, float(k)) for k in range(20)]
    b = cross.buckets(spark.createDataFrame(rows, "symbol string, trade_date date, sig double"), "sig", 5).groupBy("bucket").count().collect()
    assert {r.bucket for r in b} == {1, 2, 3, 4, 5} and all(3 <= r["count"] <= 5 for r in b)


def test_asof_directions(spark):
    left = spark.createDataFrame([("a", DAY + dt.timedelta(d)) for d in (0, 5, 9)], "k string, t date")
    right = spark.createDataFrame([("a", DAY + dt.timedelta(d), d) for d in (1, 5, 8)], "k string, u date, v int")
    get = lambda **o: [r.v for r in asof(left, "t", right, "u", ["k"], ["v"], **o).orderBy("t").collect()]
    assert get() == [None, 5, 8] and get(forward=True) == [1, 5, None] and get(forward=True, strict=True) == [1, 8, None] and get(strict=True) == [None, 1, 8]
    assert [r.v for r in nearest(left, "t", right, "u", ["k"], "v", 2).orderBy("t").collect()] == [1, 5, 8]


def test_collapse_keeps_the_first(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [("A", "x", day(0), None), ("A", "x", day(30), None), ("A", "x", day(61), None), ("A", "y", day(30), None), ("B", "x", day(30), day(31)), ("B", "x", day(40), None)]
    got = studies.collapse(spark.createDataFrame(rows, "symbol string, event_type string, event_date date, end_date date"))
    assert sorted((r.symbol, r.event_type, r.event_date) for r in got.collect()) == [("A", "x", day(0)), ("A", "x", day(61)), ("A", "y", day(30)), ("B", "x", day(30)), ("B", "x", day(40))]


def test_event_study_finds_a_jump(spark):
    a, m = walk(3, 260, 0, 0.005), walk(4, 260, 0, 0.01)
    a = a[:200] + [c * 1.1 for c in a[200:]]
    bench = spark.createDataFrame([(DAY + dt.timedelta(i), c) for i, c in enumerate(m)], "trade_date date, close double")
    events = spark.createDataFrame([("A", "jump", DAY + dt.timedelta(200), False), ("A", "none", DAY + dt.timedelta(170), False), ("A", "early", DAY + dt.timedelta(20), False)], "symbol string, event_type string, event_date date, after_close boolean")
    got = {r.event_type: r for r in studies.event_study(events, studies.paired_sessions(bars_of(spark, A=a), views.bench_returns(bench)), window=(-1, 1)).collect()}
    assert set(got) == {"jump", "none"} and abs(got["jump"].car - 0.1) < 0.03 and got["jump"].p < 0.01 < got["none"].p


def test_normal_distribution(spark):
    xs = [-8.0, -3.0, -1.0, 0.0, 0.5, 2.0, 6.5, 7.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-14 for r in got)


def test_put_call_parity_and_implied_vol(spark):
    rows = [(100.0, float(k), 30 * m, cp, 0.15 + 0.01 * m) for k in (80, 100, 120) for m in (1, 6) for cp in "CP"]
    g = options.with_greeks(spark.createDataFrame(rows, "spot double, strike double, dte int, cp string, iv double"))
    g = g.withColumn("found", options.implied_vol(F.col("price"), F.col("spot"), F.col("strike"), F.col("t"), F.col("cp") == "C"))
    out = g.collect()
    price = {(r.strike, r.dte, r.cp): r for r in out}
    for (k, d, cp), r in price.items():
        if cp == "C":
            assert abs(r.price - price[k, d, "P"].price - (100 - k * math.exp(-options.RATE * d / 365))) < 1e-9
    assert all(abs(r.found - r.iv) < 1e-6 for r in out if r.vega > 1e-3)


def test_grouped_regression_recovers_coefficients(spark):
    r = random.Random(1)
    rows = [(k, i, x, z, (1 + k) * x - 0.5 * z + 0.1 + r.gauss(0, 0.01)) for k in range(2) for i in range(300) for x, z in [(r.gauss(0, 1), r.gauss(0, 1))]]
    df = spark.createDataFrame(rows, "k int, i int, x double, z double, y double")
    for row in solve.grouped_ols(df, ["k"], "y", ["x", "z"], order="i", newey_west=True).collect():
        assert all(abs(a - b) < 0.005 for a, b in zip(row.coef, (0.1, 1 + row.k, -0.5))) and row.r2 > 0.99 and all(0 < s < 0.002 for s in row.se)


def test_publish_names_the_newest(spark, tmp_path):
    for i in (1, 2):
        payloads.publish(spark.range(i), str(tmp_path), f"v{i}")
    assert payloads.current(spark, str(tmp_path)).count() == 2


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("d", None)], "k string, v int")
    once = payloads.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)] == sorted(map(tuple, payloads.upsert(once, new, ["k"]).collect()))


def test_canonical_urls(spark):
    urls = ["HTTP://Ex.Com/a?utm_source=x&b=1#top", "http://ex.com/a?fbclid=1", "http://ex.com/a?b=1&gclid=2&c=3"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(payloads.canonical(F.col("u"))).collect()]
    assert got == ["http://ex.com/a?b=1", "http://ex.com/a", "http://ex.com/a?b=1&c=3"]


def test_windows_share_one_shuffle(spark):
    b = bars_of(spark, A=walk(1, 60))
    plan = rolling.bands(b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
