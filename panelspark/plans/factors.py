"""Registered queries: the composite of all factors that SQL can express. The model's factor
is left out: its forest is beyond SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import rolling as R
from panelspark.plans import dated, peers
from panelspark.plans.research import f18
from panelspark.registry import SQL, query
from panelspark.sources.views import bars, sql, with_returns

FACTORS = ("trend", "momentum", "volatility", "gex", "tail_risk", "valuation")
#: (least composite, label): fixed values.
LABELS = ((62, "Bullish lean"), (55, "Mildly bullish"), (46, "Neutral / mixed"), (39, "Mildly bearish"))
WORST = "Bearish lean"


def scores(spark, d) -> DataFrame:
    """(symbol, a score from -1 to 1 a factor, null where it can't be told): those of the
    latest features; spot above the newest flip of dealers' gamma or under it; the daily
    value at risk; the price over earnings."""
    r = with_returns(bars(spark, d))
    s = r.groupBy("symbol").agg((100 * F.percentile("ret", 0.05)).alias("v95"), F.max_by("close", "trade_date").alias("spot"))
    tail = F.round(R.clip(-(F.abs("v95") - 2) / 6, -0.4, 0), 6)
    flips = dated.levels(spark, d).where("gamma_flip IS NOT NULL").groupBy("symbol").agg(F.max_by("gamma_flip", "as_of").alias("flip"))
    pe = peers.metrics(spark, d).where("metric = 'forward_pe'").select("symbol", F.col("value").alias("pe"))
    own = f18(spark, d).select("symbol", "trend", "momentum", "volatility")
    j = s.join(own, "symbol", "left").join(flips, "symbol", "left").join(pe, "symbol", "left")
    gex = F.when(F.col("flip").isNotNull(), F.when(F.col("spot") >= F.col("flip"), 0.3).otherwise(-0.4))
    valuation = F.when(F.col("pe").isNotNull(), F.when(F.col("pe") < 15, 0.2).when(F.col("pe") > 30, -0.2).otherwise(0.0))
    return j.select("symbol", "trend", "momentum", "volatility", gex.alias("gex"), F.when(F.col("v95").isNotNull(), tail).alias("tail_risk"), valuation.alias("valuation"))


def composite(scores: DataFrame) -> DataFrame:
    """Adds n_factors, score (50 + 50 times the mean of the factors that are there, to the
    whole number, halves to the even one), label, and how many lean up, down, or neither
    (0.15). Rows without any factor are left out."""
    there = [F.col(k).isNotNull().cast("int") for k in FACTORS]
    n = sum(there[1:], there[0])
    total = F.coalesce(F.col(FACTORS[0]), F.lit(0.0))
    for k in FACTORS[1:]:
        total = total + F.coalesce(F.col(k), F.lit(0.0))
    of = lambda ok: sum((F.coalesce(ok(F.col(k)), F.lit(False)).cast("int") for k in FACTORS[1:]), F.coalesce(ok(F.col(FACTORS[0])), F.lit(False)).cast("int"))
    out = scores.withColumn("n_factors", n).where("n_factors > 0").withColumn("score", F.bround(50 + 50 * (total / F.col("n_factors")), 0).cast("int"))
    label = F.when(F.col("score") >= LABELS[0][0], LABELS[0][1])
    for least, name in LABELS[1:]:
        label = label.when(F.col("score") >= least, name)
    return out.withColumns({"label": label.otherwise(WORST), "bull": of(lambda c: c > 0.15), "bear": of(lambda c: c < -0.15), "neutral": of(lambda c: c.between(-0.15, 0.15))})


_ANY = lambda test: " + ".join(f"coalesce({k} {test}, false)::INT" for k in FACTORS)
COMPOSITE = (
    f"fs AS ({SQL['f18_factor_scores']}), st AS (SELECT symbol, 100 * quantile_cont(ret, 0.05) AS v95, arg_max(close, trade_date) AS spot FROM r GROUP BY symbol), "
    f"fp AS (SELECT symbol, arg_max(gamma_flip, as_of) AS flip FROM ({SQL['w28_dated_levels'].replace('round(gamma_flip, 6) AS gamma_flip', 'gamma_flip')}) WHERE gamma_flip IS NOT NULL GROUP BY symbol), "
    f"pe AS (SELECT symbol, value AS pe FROM (WITH {peers.PEERS.replace('FROM sectors', 'FROM (SELECT NULL::VARCHAR AS symbol, NULL::VARCHAR AS sector, NULL::VARCHAR AS industry)')} SELECT * FROM me) WHERE metric = 'forward_pe'), "
    "sx AS (SELECT symbol, trend, momentum, volatility::DOUBLE AS volatility, CASE WHEN flip IS NOT NULL THEN CASE WHEN spot >= flip THEN 0.3 ELSE -0.4 END END::DOUBLE AS gex, CASE WHEN v95 IS NOT NULL THEN round(greatest(-0.4, least(0, -(abs(v95) - 2) / 6)), 6) END::DOUBLE AS tail_risk, CASE WHEN pe IS NOT NULL THEN CASE WHEN pe < 15 THEN 0.2 WHEN pe > 30 THEN -0.2 ELSE 0.0 END END::DOUBLE AS valuation FROM st LEFT JOIN fs USING (symbol) LEFT JOIN fp USING (symbol) LEFT JOIN pe USING (symbol)), "
    f"cx AS (SELECT *, ({' + '.join(f'({k} IS NOT NULL)::INT' for k in FACTORS)})::INT AS n_factors, {' + '.join(f'coalesce({k}, 0)' for k in FACTORS)} AS total FROM sx), cy AS (SELECT *, round_even(50 + 50 * (total / n_factors), 0)::INT AS score FROM cx WHERE n_factors > 0)"
)


@query("a40_f18_composite_lean", sql("r", ctes=COMPOSITE, recursive=True, body=f"SELECT symbol, {', '.join(FACTORS)}, n_factors, score, CASE " + " ".join(f"WHEN score >= {a} THEN '{b}'" for a, b in LABELS) + f" ELSE '{WORST}' END AS label, ({_ANY('> 0.15')})::INT AS bull, ({_ANY('< -0.15')})::INT AS bear, ({_ANY('BETWEEN -0.15 AND 0.15')})::INT AS neutral FROM cy"))
def a40(spark, d) -> DataFrame:
    return composite(scores(spark, d))
