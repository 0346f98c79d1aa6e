"""Evaluation of several signals at once: the signal is a key beside the date."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.cross import newey_west

GATES = {"dates": 63, "t": 2.0, "net_sharpe": 0.0, "deflated": 0.5}


IC_LEAST, SPREAD_LEAST, BUCKETS = 10, 20, 10


def _ranks(value: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The mean rank of each value of ``order`` (places by value), not-a-number above all, at its place."""
    v = value[order]
    new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))))
    end = np.append(new[1:], len(v))
    out = np.empty(len(value))
    out[order] = np.repeat((new + end + 1) / 2, end - new)
    return out


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x - x.mean(), y - y.mean()
    s = np.sqrt((x * x).mean()) * np.sqrt((y * y).mean())
    return float((x * y).mean() / s) if s > 0 else 0.0


def _column(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = t[name].combine_chunks()
    return c.fill_null(np.nan).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)


def _evaluated(t: pa.Table, columns: dict[str, str], forwards: list[str], every: bool) -> list[dict]:
    """A row a signal of one date's rows, which go by symbol. Each column is sorted once."""
    ahead = [_column(t, f) for f in forwards]
    orders = [np.argsort(y) for y, _ in ahead]
    rows = []
    for signal, name in columns.items():
        x, there = _column(t, name)
        if not (every or there.any()):
            continue
        order = np.argsort(x, kind="stable")  # ties by symbol
        row = {"signal": signal, "n": [], "ic": [], "spread": None, "low": None, "high": None}
        for i, ((y, known), by) in enumerate(zip(ahead, orders)):
            both = there & known
            at = order[both[order]]
            row["n"].append(len(at))
            row["ic"].append(_correlation(_ranks(x, at)[both], _ranks(y, by[both[by]])[both]) if len(at) >= IC_LEAST else None)
            if i == 0 and len(at) >= SPREAD_LEAST:
                bucket = np.maximum(1, np.ceil(np.arange(len(at)) * BUCKETS / (len(at) - 1)))
                low, high = at[bucket == 1], at[bucket == BUCKETS]
                row |= {"spread": float(y[high].mean() - y[low].mean()), "low": t["symbol"].take(low).to_pylist(), "high": t["symbol"].take(high).to_pylist()}
        rows.append(row)
    return rows


def daily(panel: DataFrame, forwards: list[str], signals: tuple | None = None) -> DataFrame:
    """(signal, trade_date, n, ic, spread, low, high) of each date: names and rank correlation (ties
    averaged; 0 if a side is constant, null under IC_LEAST names) by ``forwards``, and for the first
    of them the top less the bottom of BUCKETS buckets and their symbols, from SPREAD_LEAST names
    on. Rows are (signal, symbol, trade_date, value, forwards), or have a column for each of
    ``signals``, so a row is moved once for all of them. A date's cross-section goes to one task, as in a window by date."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("symbol")
        if signals:
            rows = _evaluated(t, {s: s for s in signals}, forwards, False)
        else:
            rows = [r for s in pc.unique(t["signal"]).to_pylist() for r in _evaluated(t.filter(pc.equal(t["signal"], s)), {s: "value"}, forwards, True)]
        day = t["trade_date"][0].as_py()
        return pa.Table.from_pylist([r | {"trade_date": day} for r in rows], SHAPE)

    rows = panel.select("trade_date", "symbol", *(signals or ("signal", "value")), *forwards)
    if not signals:
        rows = rows.where("signal IS NOT NULL")
    return rows.groupBy("trade_date").applyInArrow(run, "signal string, trade_date date, n array<bigint>, ic array<double>, spread double, low array<string>, high array<string>")


SHAPE = pa.schema([("signal", pa.string()), ("trade_date", pa.date32()), ("n", pa.list_(pa.int64())), ("ic", pa.list_(pa.float64())), ("spread", pa.float64()), ("low", pa.list_(pa.string())), ("high", pa.list_(pa.string()))])


def spreads(day: DataFrame, cost_bps: float = 10) -> DataFrame:
    """(signal, trade_date, spread, turnover, net) of ``daily``: top less bottom, the change of equal
    weights on the date before, and what the cost of that leaves."""
    s = day.where("low IS NOT NULL")
    dates = s.select("signal", "trade_date").withColumn("d", F.row_number().over(Window.partitionBy("signal").orderBy("trade_date")))
    s = s.join(dates, ["signal", "trade_date"]).select("signal", "trade_date", "d", "spread", "low", "high")
    before = s.select("signal", (F.col("d") + 1).alias("d"), F.col("low").alias("low0"), F.col("high").alias("high0"))

    def moved(side: str) -> Column:
        """What stays changes by the difference of the two weights, what comes or goes by its own."""
        n, n0 = F.size(side), F.when(F.col(f"{side}0").isNotNull(), F.size(f"{side}0")).otherwise(0)
        both = F.coalesce(F.size(F.array_intersect(side, f"{side}0")), F.lit(0))
        both = F.when(n0 > 0, both).otherwise(0)
        gone = F.when(n0 > 0, (n0 - both) / n0 + both * F.abs(1 / n - 1 / n0)).otherwise(0.0)
        return (n - both) / n + gone

    s = s.join(before, ["signal", "d"], "left").withColumn("turnover", (moved("low") + moved("high")) / 2)
    return s.select("signal", "trade_date", "spread", "turnover", (F.col("spread") - F.col("turnover") * 2 * cost_bps / 1e4).alias("net"))


def evaluate(panel: DataFrame, horizons: dict[str, str], deflated, signals: tuple | None = None) -> DataFrame:
    """A row a signal, one without a full cross-section too: mean rank correlations by horizon, the first one's Newey-West t,
    spread, turnover, Sharpe ratios before and after cost, deflated Sharpe ratio, gates.
    ``deflated`` makes the last from (n, sr, skewness, kurtosis), population moments. Panels as in
    ``daily``, which is kept: it has a row a signal and date, and all else is made from it."""
    day = daily(panel, list(horizons.values()), signals).cache()
    nw = newey_west(day.select("signal", "trade_date", F.get("ic", F.lit(0)).alias("ic")), "ic", ["signal"], "trade_date").select("signal", F.col("n").alias("dates"), "t")
    out = day.groupBy("signal").agg(*[F.round(F.avg(F.get("ic", F.lit(i))), 6).alias(f"ic_{k}") for i, k in enumerate(horizons)])
    out = out.join(nw, "signal", "left").withColumn("dates", F.coalesce("dates", F.lit(0).cast("bigint")))
    year = 252**0.5
    s = spreads(day).groupBy("signal").agg(F.count("*").alias("n"), F.avg("spread").alias("m"), F.stddev_samp("spread").alias("sd"), F.avg("turnover").alias("turnover"), F.avg("net").alias("nm"), F.stddev_samp("net").alias("ns"), F.skewness("net").alias("g1"), F.kurtosis("net").alias("g2"))
    s = s.withColumn("dsr", deflated(F.col("n"), F.try_divide("nm", "ns"), F.col("g1"), F.col("g2")))
    out = out.join(s, "signal", "left").select("signal", "dates", *[f"ic_{k}" for k in horizons], "t", F.round(F.col("m") * 252, 6).alias("spread_year"), F.round(F.try_divide("m", "sd") * year, 6).alias("gross_sharpe"), F.round("turnover", 6).alias("turnover"), F.round(F.try_divide("nm", "ns") * year, 6).alias("net_sharpe"), F.round("dsr", 6).alias("deflated"))
    at = lambda c, ok: F.when(~F.coalesce(ok, F.lit(False)), c)
    reasons = F.array_compact(F.array(at("t", F.abs("t") >= GATES["t"]), at("net_sharpe", F.col("net_sharpe") > GATES["net_sharpe"]), at("deflated", F.col("deflated") > GATES["deflated"])))
    short = F.col("dates") < GATES["dates"]
    status = F.when(short, "insufficient_history").when(F.size(reasons) == 0, "validated").otherwise("failed_validation")
    return out.select("*", status.alias("status"), F.when(short, F.array(F.lit("dates"))).otherwise(reasons).alias("reasons"))
