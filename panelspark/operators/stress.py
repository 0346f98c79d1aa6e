"""Stress scenarios: replay of named windows, else shocks implied by factor loadings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCENARIO = "scenario string, start date, trough date, end date, factor string, shock double"


def replay(bars: DataFrame, scenarios: list[tuple], loadings: DataFrame | None = None) -> DataFrame:
    """A row for each symbol and scenario: drop from the highest to the lowest close within
    five days of the window, in per cent; the recovery from that low to the last close up
    to a week after the end, if the history reaches to a week before it; else the sum of
    ``loadings`` (symbol, factor, beta) times the scenario's shocks; else neither. method:
    'historical replay', 'factor-implied', 'insufficient history'. ``scenarios``: (name,
    start, trough, end, {factor: shock}), few and a constant of the plan. A history covers
    a window if it begins within a week of its start and ends a week before its trough or
    later, with two closes in it. A null beta adds nothing."""
    cases = F.array(*[
        F.struct(F.lit(k).alias("scenario"), F.lit(a).cast("date").alias("start"), F.lit(t).cast("date").alias("trough"), F.lit(e).cast("date").alias("end"))
        for k, a, t, e, _ in scenarios
    ])
    inside = lambda s: F.col("trade_date").between(F.date_sub(s["start"], 5), F.greatest(F.date_add(s["trough"], 5), F.date_add(s["end"], 7)))
    span = bars.groupBy("symbol").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    pairs = span.select("symbol", "first", "last", F.inline(cases))
    rows = bars.where("close IS NOT NULL").withColumn("s", F.explode(F.filter(cases, inside))).select("s.*", "symbol", "trade_date", "close")
    fall = F.col("trade_date") <= F.date_add("trough", 5)
    after = F.col("trade_date").between(F.col("trough"), F.date_add("end", 7))
    g = rows.groupBy("symbol", "scenario").agg(
        F.count_if(fall).alias("sessions"), F.max(F.when(fall, F.col("close"))).alias("peak"), F.min(F.when(fall, F.col("close"))).alias("low"),
        F.count_if(after).alias("later"), F.max_by("close", F.when(after, F.col("trade_date"))).alias("final"),
    )
    out = pairs.join(g, ["symbol", "scenario"], "left")
    covers = (F.col("first") <= F.date_add("start", 7)) & (F.col("last") >= F.date_sub("trough", 7)) & (F.coalesce("sessions", F.lit(0)) >= 2)
    recovered = covers & (F.col("later") >= 2) & (F.col("last") >= F.date_sub("end", 7))
    shocks = [(k, f, float(x)) for k, *_, of in scenarios for f, x in of.items()]
    if loadings is not None and shocks:
        given = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(f).alias("factor"), F.lit(x).alias("shock")) for k, f, x in shocks])
        implied = loadings.where("beta IS NOT NULL AND NOT isnan(beta)").withColumn("s", F.explode(F.filter(given, lambda s: s["factor"] == F.col("factor"))))
        implied = implied.groupBy("symbol", "s.scenario").agg(F.sum(F.col("beta") * F.col("s.shock")).alias("implied"))
        out = out.join(implied, ["symbol", "scenario"], "left")
    else:
        out = out.withColumn("implied", F.lit(None).cast("double"))
    drop = F.when(covers, (F.col("low") / F.col("peak") - 1) * 100).otherwise(F.col("implied") * 100)
    method = F.when(covers, "historical replay").when(F.col("implied").isNotNull(), "factor-implied").otherwise("insufficient history")
    return out.select("symbol", "scenario", method.alias("method"), F.round(drop, 2).alias("drop_pct"), F.round(F.when(recovered, (F.col("final") / F.col("low") - 1) * 100), 2).alias("recovery_pct"))
