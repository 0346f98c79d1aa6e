"""Receipts, calendar changes, exits, the composite of factors: by hand."""

import datetime as dt

from panelspark import registry  # noqa: F401  plans import each other through it
from panelspark.operators import horizons
from panelspark.plans import factors
from panelspark.sources import payloads

NOW = dt.datetime(2024, 1, 31)
PANELS = [("p", "source", 24), ("q", "other", 1)]


def test_receipts(spark):
    ago = lambda **k: NOW - dt.timedelta(**k)
    rows = [
        ("p", 1, ago(minutes=30), []), ("p", 2, ago(hours=24), []), ("p", 3, ago(hours=47, minutes=29), []), ("p", 4, None, []), ("p", 5, ago(hours=90), ["rate", "spread"]), ("p", 6, NOW + dt.timedelta(hours=5), []),
        ("p", 7, ago(hours=100), []), ("p", 7, ago(hours=2), []), ("p", 9, None, None), ("other", 1, NOW, []),
    ]
    seen = spark.createDataFrame(rows, "panel string, key bigint, as_of timestamp, assumed array<string>")
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 1)], "key bigint")
    got = {(r.key, r.panel): (r.age_text, r.state, r.note) for r in payloads.panel_receipts(wanted, PANELS, seen, "2024-01-31").collect()}
    assert len(got) == 18 and all(v == ("", "unavailable", "") for (_, p), v in got.items() if p == "q")
    own = {k: v for (k, p), v in got.items() if p == "p"}
    assert own[1] == ("<1h old", "live", "") and own[2] == ("24h old", "live", "") and own[3] == ("47h old", "stale", "") and own[4] == own[9] == ("", "no_asof", "")
    assert own[5] == ("4d old", "assumed", "assumed inputs: rate, spread") and own[6] == ("<1h old", "live", "") and own[7] == ("2h old", "live", "") and own[8] == ("", "unavailable", "")


def bars(spark, rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(t), float(c), v) for s, t, c, v in rows], "symbol string, trade_date date, close double, volume bigint")


def test_calendar_changes(spark):
    b = bars(spark, [("a", "2023-03-31", 100, 1), ("a", "2023-02-25", 50, 1), ("a", "2023-01-03", 80, 1), ("a", "2022-04-20", 25, 1), ("a", "2018-01-01", 10, 1), ("b", "2023-03-31", 7, 1)])
    got = {(r.symbol, r.period): (r.matched and r.matched.isoformat(), r.change_pct) for r in horizons.calendar_changes(b).collect()}
    assert len(got) == 26
    assert got["a", "1M"] == ("2023-02-25", 100.0) and got["a", "3M"] == ("2023-01-03", 25.0) and got["a", "1Y"] == ("2022-04-20", 300.0)  # the nearer of both sides
    assert got["a", "YTD"] == ("2023-01-03", 25.0) and got["a", "1W"] == ("2023-03-31", 0.0) and got["a", "2Y"] == (None, None) and got["a", "5Y"] == (None, None)
    assert got["b", "1W"] == ("2023-03-31", 0.0) and got["b", "2M"] == (None, None) and horizons.calendar_changes(b.limit(0)).count() == 0


def test_exits(spark):
    rows = [("a", f"2023-01-{i:02d}", 10, 100_000 if i > 10 else 0) for i in range(1, 31)] + [("b", f"2023-01-{i:02d}", 1, 10) for i in range(1, 6)] + [("c", "2023-01-01", 1, 1)]
    spreads = spark.createDataFrame([("a", 0.02)], "symbol string, spread double")
    got = {r.symbol: r for r in horizons.exit_costs(bars(spark, rows), spreads).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert a.adv_20 == 1e6 and round(a.adv_60) == 666_667 and a.days_to_exit_1pct == 10 and a.days_to_exit_5pct == 2 and a.half_spread_cost == 1000 and not a.illiquid and a.warning is None
    assert b.illiquid and b.warning == "slow exit" and b.half_spread_cost is None


def test_composite(spark):
    rows = [("all", 1.0, 1.0, 0.2, 0.3, 0.0, 0.2), ("none", *[None] * 6), ("one", None, None, None, -0.4, None, None), ("tie", 0.01, None, None, None, None, None), ("edge", 0.15, -0.15, None, None, None, None)]
    names = "symbol string, " + ", ".join(f"{k} double" for k in factors.FACTORS)
    got = {r.symbol: (r.n_factors, r.score, r.label, r.bull, r.bear, r.neutral) for r in factors.composite(spark.createDataFrame(rows, names)).collect()}
    assert got == {"all": (6, 72, "Bullish lean", 5, 0, 1), "one": (1, 30, "Bearish lean", 0, 1, 0), "tie": (1, 50, "Neutral / mixed", 0, 0, 1), "edge": (2, 50, "Neutral / mixed", 0, 0, 2)}
