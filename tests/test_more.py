"""Feeds, surfaces, snapshot histories, signal evaluation, models: hand-built frames."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf
from panelspark.operators import models, rolling, signals, studies, surfaces
from panelspark.sources import feeds, views
from tests.test_operators import BAR, DAY, bars_of, walk


def test_folds_equal_plain_loops(spark):
    c = walk(5, 150)
    got = rolling.recursive(views.with_returns(bars_of(spark, A=c))).orderBy("trade_date").collect()
    ema, up, down = c[0], [], []
    for i, r in enumerate(got):
        ema = c[i] * 2 / 9 + ema * 7 / 9 if i else c[0]
        assert abs(r.ema_8 - ema) < 1e-9
        if i:
            up.append(max(c[i] - c[i - 1], 0))
            down.append(max(c[i - 1] - c[i], 0))
        gain, loss = (sum(x * (13 / 14) ** k for k, x in enumerate(reversed(xs))) for xs in (up, down))
        want = 100 - 100 / (1 + gain / loss) if len(up) >= 14 and loss else 50
        assert abs(r.rsi_14 - want) < 1e-6
    rets = [b / a - 1 for a, b in zip(c, c[1:])]
    v = np.var(rets[:60], ddof=1)
    for r, x in zip(got[61:], rets[60:]):
        assert abs(r.ewma_var - v) < 1e-12
        v = 0.94 * v + 0.06 * x * x


def test_composite_is_neutral_without_history(spark):
    s = rolling.composite(bars_of(spark, A=[100.0 + k for k in range(80)], B=[50.0] * 10)).collect()
    score = {(r.symbol, r.rn): r.score for r in s}
    assert score["A", 49] == score["B", 10] == 50 and 50 < score["A", 80] <= 100


def test_quantile_of_a_sorted_array(spark):
    xs = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    r = spark.createDataFrame([(xs,), ([],)], "x array<double>").select(F.array_sort("x").alias("x")).select(rolling.quantile("x", 0.05).alias("a"), rolling.quantile("x", 0.5).alias("b"), rolling.quantile("x", 1.0).alias("c")).collect()
    assert [round(v, 9) for v in r[0]] == [round(float(np.quantile(xs, p)), 9) for p in (0.05, 0.5, 1.0)] and r[1].a is None


def test_daily_returns_add_up_to_the_car(spark):
    a, m = walk(3, 260, 0, 0.005), walk(4, 260, 0, 0.01)
    bench = spark.createDataFrame([(DAY + dt.timedelta(i), c) for i, c in enumerate(m)], "trade_date date, close double")
    s = studies.paired_sessions(bars_of(spark, A=a), views.bench_returns(bench))
    e = spark.createDataFrame([("A", "x", DAY + dt.timedelta(170), False), ("A", "x", DAY + dt.timedelta(170), True)], "symbol string, event_type string, event_date date, after_close boolean")
    st = studies.event_study(e, s)
    last = {r.after_close: r for r in st.collect()}
    days = studies.daily_abnormal(st, s).where("day = 30").collect()
    assert len(days) == 2 and all(abs(r.cumulative - last[r.after_close].car) < 1e-4 for r in days)
    assert last[True].session == last[False].session + dt.timedelta(1)


def test_feeds(spark):
    text = lambda *xs: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(xs)], "k int, t string")
    lists = text({"data": {"data": {"rows": [{"symbol": " ab ", "companyName": "A B Inc. Common Stock", "sector": None}, {"companyName": "x"}]}}}, {"other": 1})
    assert [tuple(r) for r in feeds.index_members(lists, "t", (2, 9)).select("k", "size", "plausible", "symbol", "name", "sector").collect()] == [(0, 1, False, "AB", "A B Inc.", "")]
    lines = spark.createDataFrame([("preamble 19260701",), ("  19260701   0.10  -0.25",), ("19260702,1.0,2.0",), ("1926  1.0 2.0",), ("Copyright",)], "l string")
    assert sorted(map(tuple, feeds.factor_rows(lines, "l", ["a", "b"]).collect())) == [(dt.date(1926, 7, 1), 0.001, -0.0025), (dt.date(1926, 7, 2), 0.01, 0.02)]
    obs = text({"observations": [{"date": "2020-01-01", "value": "."}, {"date": "2020-02-01", "value": "1.5"}, {"date": "2020-03-01", "value": ""}]}, {})
    assert [tuple(r) for r in feeds.observations(obs, "t").collect()] == [(dt.date(2020, 2, 1), 1.5)]
    f = text({"filings": {"recent": {"form": ["8-K", "10-Q", "8-K/A"], "filingDate": ["2020-01-02", "2020-01-03", "2020-01-04"], "accessionNumber": ["a", "b", "c"], "items": ["5.02, 2.02;9.99 2.02", "1.01", "5.07"]}}})
    assert sorted(tuple(r)[1:] for r in feeds.filings(f, "t", "k").collect()) == [("a", "8-K", dt.date(2020, 1, 2), "5.02,2.02", False, "management"), ("c", "8-K/A", dt.date(2020, 1, 4), "5.07", False, None)]
    s = text({"sharesShort": 110, "sharesShortPriorMonth": 100}, {"shortRatio": 2.0}, {"shortPercentOfFloat": 3.0, "sharesShortPriorMonth": 0})
    assert sorted((r.k, r.change) for r in feeds.short_interest(s, "t", "k").collect()) == [(0, 0.1), (2, None)]
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted((r.k, r.v, r.feed) for r in feeds.first_feed([one, two], "k").collect()) == [("a", 1, 1), ("b", 3, 2)]


def test_smile_is_recovered(spark):
    a, b, rho, m, s = 0.02, 0.3, -0.4, 0.0, 0.1
    ks = [-0.3 + 0.05 * i for i in range(13)]
    rows = [("u", 30, k, a + b * (rho * (k - m) + math.sqrt((k - m) ** 2 + s * s))) for k in ks] + [("v", 30, 0.1, 0.2)]
    got = {r.underlying: r for r in surfaces.svi_fit(spark.createDataFrame(rows, "underlying string, dte int, k double, w double"), ["underlying", "dte"]).collect()}
    assert all(abs(got["u"][k] - v) < 1e-6 for k, v in (("a", a), ("b", b), ("rho", rho), ("m", m), ("sigma", s))) and got["u"].fitted and got["u"].arbitrage_free and not got["v"].fitted


def test_density_of_lognormal_prices(spark):
    spot, v, t = 100.0, 0.2, 0.5
    ks = [40.0 + 2 * i for i in range(91)]
    base = spark.createDataFrame([("u", k, spot, t) for k in ks], "u string, strike double, spot double, t double")
    d1 = (F.ln(spot / F.col("strike")) + (surfaces.RATE + v * v / 2) * t) / (v * math.sqrt(t))
    priced = base.withColumn("price", spot * cdf(d1) - F.col("strike") * math.exp(-surfaces.RATE * t) * cdf(d1 - v * math.sqrt(t)))
    r = surfaces.density(priced, ["u"]).first()
    mu, sd = (surfaces.RATE - v * v / 2) * t, v * math.sqrt(t)
    tail = 100 * 0.5 * math.erfc((math.log(1.1) - mu) / sd / math.sqrt(2))
    assert r.reason is None and abs(r.total - 1) < 0.01 and abs(r.up_10 - tail) < 1.5
    bent = priced.withColumn("price", F.when(F.col("strike") == 100, F.col("price") + 5).otherwise(F.col("price")))
    assert surfaces.density(bent, ["u"]).first().reason == "monotonicity" and surfaces.density(priced.where("strike < 46"), ["u"]).first().reason == "too few strikes"


def test_surface_is_linear_and_flat_beyond(spark):
    rows = [("u", d, 100.0, k, iv) for d in (7, 14) for k, iv in ((90.0, 0.3), (110.0, 0.5), (110.0, 0.7), (115.0, 9.0))]
    g = {(r.dte, r.moneyness): r.iv for r in surfaces.surface_grid(spark.createDataFrame(rows, "underlying string, dte int, spot double, strike double, iv double")).collect()}
    assert len(g) == 42 and g[7, 0.8] == g[7, 0.9] == 30 and abs(g[7, 1.0] - 45) < 1e-9 and g[14, 1.2] == 60


def test_snapshots_replace_and_rank(spark):
    day = lambda n: DAY + dt.timedelta(n)
    old = spark.createDataFrame([("A", day(i), float(i), 0) for i in range(10)], "symbol string, trade_date date, v double, at int")
    new = spark.createDataFrame([("A", day(9), 4.5, 0), ("B", day(1), None, 1)], "symbol string, trade_date date, v double, at int")
    s = surfaces.replaced(old, new, ["symbol", "trade_date"], "at")
    assert s.count() == 11 and surfaces.replaced(s, new, ["symbol", "trade_date"], "at").count() == 11
    h = surfaces.history(s, "v").collect()
    assert [(r.symbol, r.now, r.n, r.below, r.low, r.high) for r in h] == [("A", 4.5, 10, 5, 0.0, 8.0)]


def test_gates_tell_a_planted_signal(spark):
    r = random.Random(7)
    rows = [(k, f"{i:02d}", DAY + dt.timedelta(d), s if k == "good" else r.gauss(0, 1), f) for d in range(80) for i in range(30) for s in [r.gauss(0, 1)] for f in [0.02 * s + r.gauss(0, 0.03)] for k in ("good", "noise")]
    p = spark.createDataFrame(rows, "signal string, symbol string, trade_date date, value double, f1 double")
    out = {x.signal: x for x in signals.evaluate(p, {"1d": "f1"}, lambda n, sr, g1, g2: cdf(sr * F.sqrt(n))).collect()}
    assert out["good"].status == "validated" and out["good"].ic_1d > 0.4 and out["noise"].status == "failed_validation" and "t" in out["noise"].reasons
    by_hand = pd.DataFrame(rows, columns=["k", "s", "d", "v", "f"]).query("k == 'good'").groupby("d")[["v", "f"]].apply(lambda g: g["v"].rank().corr(g["f"].rank())).mean()
    assert abs(out["good"].ic_1d - by_hand) < 1e-5


def test_models_find_planted_labels(spark):
    r = random.Random(3)
    rows = [(f"S{k}", DAY + dt.timedelta(d), x, r.gauss(0, 1), (1 if x > 0.7 else -1 if x < -0.7 else 0), 0.05 * x) for d in range(160) for k in range(6) for x in [r.gauss(0, 1)]]
    df = models.prepared(spark.createDataFrame(rows, "symbol string, trade_date date, x1 double, x2 double, label int, realised double"), ["x1", "x2"]).cache()
    oof = models.out_of_fold(df).cache()
    c = models.calibrated(oof).cache()
    one, raw = models.card(c, "c").first(), models.card(c, "p").first()
    assert oof.count() == len(rows) == one.n and oof.groupBy("symbol", "trade_date").count().where("count > 1").isEmpty()
    assert one.hit_rate > 0.9 and one.ic > 0.7 and one.ic_t > 10 and one.brier <= raw.brier + 0.02
    assert c.where("abs(c_sell + c_hold + c_buy - 1) > 1e-9").isEmpty() and sum(one[f"{a}_as_{b}"] for a in ("sell", "hold", "buy") for b in ("sell", "hold", "buy")) == one.n


def test_bars_schema_is_kept(spark):
    assert [f.name for f in bars_of(spark, A=[1.0]).schema.fields] == [x.split()[0] for x in BAR.split(", ")]


def test_folds_of_many_symbols(spark):
    """Symbols of any length, over several chunks and matrices, as each symbol's own fold."""
    rng = np.random.default_rng(5)
    closes = {f"S{i}": (np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 50).tolist() for i, n in enumerate((1, 2, 3, 59, 60, 61, 62, 64, 130, 300, 7))}
    r = rolling.recursive(views.with_returns(bars_of(spark, **closes)), ("ema_8", "median_ret", "ewma_var", "rsi_14"), chunk=100)
    assert not {"rsi_2", "macd_hist", "__k"} & set(r.columns)
    assert "MapInArrow" in r._jdf.queryExecution().toString()  # no group a symbol
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        got = r.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, closes.values()))
    for k, c in closes.items():
        g, c = got[got["symbol"] == k].sort_values("trade_date"), pd.Series(c)
        ret = c / c.shift(1) - 1
        np.testing.assert_allclose(g["ema_8"], c.ewm(alpha=2 / 9, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(g["median_ret"].astype(float), ret.rolling(252, min_periods=50).median(), rtol=1e-12)
        var = np.full(len(c), np.nan)
        if len(c) > 61:
            v = ret.iloc[1:61].var()
            for i in range(61, len(c)):
                var[i] = v
                v = 0.94 * v + 0.06 * ret.iloc[i] ** 2
        np.testing.assert_allclose(g["ewma_var"].astype(float), var, rtol=1e-9)
        assert g["rsi_14"].iloc[0] == 50


def test_bands_of_moves_go_by_the_unrounded_deviate(spark):
    """2.9999998 deviations are notable, though they show as 3."""
    before = [0.01, -0.01] * 10
    sd, mean = np.std(before, ddof=1), np.mean(before)
    closes = [100.0]
    for r in [*before, mean + 2.9999998 * sd]:
        closes.append(float(closes[-1] * (1 + r)))
    last = rolling.session_moves(bars_of(spark, A=closes)).orderBy(F.desc("trade_date")).first()
    assert (last.z, last.band) == (3.0, "notable")


def test_rounding_is_the_engines(spark, duck):
    x = [0.0003125, 1.0000005, -2.5000005, 7003738617.484773, 5.0885708762435776e22, 1e305, None]
    want = [duck.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in x]
    got = rolling.rounded(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double"), 6, "x").orderBy("i").collect()
    assert [r.x for r in got] == want


def test_class_weights_move_no_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df: seen.append(df))
    rows = spark.createDataFrame([(float(i % 3 != 0), i) for i in range(9)], "y double, x int")
    models.fitted(rows)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted({(r.y, round(r.weight, 9)) for r in seen[0].collect()}) == [(0.0, round(1 / 3, 9)), (1.0, round(1 / 6, 9))]
    assert models.fitted(rows.where("y = 1")) is None
