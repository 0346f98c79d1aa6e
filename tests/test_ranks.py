"""Ranks over whole tables, and pairs of symbols by blocks: brute force, plans."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cross, ranks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ranges", [1, 4, 64])
@pytest.mark.parametrize("values", [300, 5])
def test_positions(spark, ranges, values):
    r = random.Random(values)
    xs = [round(r.gauss(0, 1), 2) + 0.0 if values > 5 else float(r.randrange(values)) for _ in range(500)] + [None, None, float("nan"), math.inf, -math.inf]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    known = [x for x in xs if x is not None]
    less = lambda a, b: a < b if not math.isnan(b) else not math.isnan(a)
    want = sorted((repr(x), sum(y == x or (y != y and x != x) for y in known), sum(less(y, x) for y in known)) for x in {repr(x): x for x in known}.values())
    assert sorted((repr(a), b, c) for a, b, c in ranks.positions(df, "x", ranges).collect()) == want


def test_numbered_and_average_ranks(spark):
    r = random.Random(2)
    rows = [(i, float(r.randrange(30)) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, x double").repartition(7)
    order = sorted(rows, key=lambda t: (t[1] is None, t[1] or 0, t[0]))
    assert {t.i: t.n for t in ranks.numbered(df, "x", "i", ranges=8).collect()} == {i: k for k, (i, _) in enumerate(order, 1)}
    places = {}
    for k, (_, x) in enumerate(order, 1):
        places.setdefault(x, []).append(k)
    got = {t.i: t.k for t in ranks.average_ranks(df, "x", "k").collect()}
    assert got == {i: None if x is None else float(np.mean(places[x])) for i, x in rows}
    assert ranks.numbered(df.limit(0), "x", "i").count() == 0 and ranks.positions(df.limit(0), "x").count() == 0


def test_hot_values_and_plan(spark):
    """A third of the rows share a value: one row after counting; no window over all rows."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
    p = ranks.positions(df, "x")
    assert p.where("x = 7").first().same >= 10_000 and p.agg(F.sum("same")).first()[0] == 30_000
    shown = plan(p)
    assert shown.count("SinglePartition") <= 1 and "hashpartitioning(__r" in shown


def test_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(cross, "BLOCK", 4)
    r = np.random.default_rng(3)
    day = dt.date(2020, 1, 1)
    series = {f"S{i:02d}": {day + dt.timedelta(days=int(k)): 100 * float(np.exp(r.normal(0, 0.02))) for k in range(80) if r.random() < 0.9} for i in range(15)}
    series["FLAT"] = {day + dt.timedelta(days=k): 5.0 for k in range(80)}
    df = spark.createDataFrame([(s, t, x) for s, own in series.items() for t, x in own.items()], "symbol string, trade_date date, close double")
    returns = {}
    for s, own in series.items():
        days = sorted(own)
        returns[s] = {b: own[b] / own[a] - 1 for a, b in zip(days, days[1:])}
    want = {}
    for a in returns:
        for b in returns:
            both = sorted(returns[a].keys() & returns[b].keys())
            if a <= b and len(both) >= 20:
                x, y = ([returns[s][t] for t in both] for s in (a, b))
                flat = np.std(x) == 0 or np.std(y) == 0
                want[a, b] = (len(both), None if flat else np.corrcoef(x, y)[0, 1], np.cov(x, y)[0, 1] * 252)
    got = {(t.a, t.b): (t.n, t.correlation, t.covariance) for t in cross.pairwise(df, 20).collect()}
    assert got.keys() == want.keys()
    for k, (n, c, v) in want.items():
        assert got[k][0] == n and got[k][2] == pytest.approx(v, abs=2e-6) and (c is None and got[k][1] is None or got[k][1] == pytest.approx(c, abs=2e-6))
    assert cross.pairwise(df.limit(0)).count() == 0


def test_blocks_of_symbols_are_written_once(spark, monkeypatch):
    """Several blocks a group: each pair once, none across groups, and values aren't copied a block."""
    monkeypatch.setattr(cross, "BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(g, f"{g}{i}", dt.date(2020, 1, 1) + dt.timedelta(int(k)), float(rng.choice([-1.0, 0.0, 0.5]))) for g in (0, 1) for i in range(8) for k in rng.choice(40, 25, replace=False)]
    df = spark.createDataFrame(rows, "grp int, symbol string, trade_date date, ret double")
    pairs = cross.common_moves(df)
    got = {(r.a, r.b): (r.n, r.together) for r in pairs.collect()}
    by = {}
    for g, s, t, x in rows:
        by.setdefault(s, {})[t] = x
    want = {(a, b): (len(c), sum(np.sign(by[a][t]) == np.sign(by[b][t]) for t in c)) for a in by for b in by if a < b and a[0] == b[0] and (c := by[a].keys() & by[b].keys())}
    assert got == want and len(want) == 2 * 28
    assert "explode" not in pairs._jdf.queryExecution().toString()
