"""Registered queries: the five strategies by symbol, and their universe against the benchmark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import cross as C
from panelspark.operators import rolling as R
from panelspark.plans.cross_sections import PERF, PERF_BODY
from panelspark.plans.panels import frame, full
from panelspark.registry import SQL, query
from panelspark.sources.views import bars, bench, bench_returns, by_symbol, sql

#: Of the original: fixed values.
STRATEGIES = ("relative_strength", "dual_momentum", "sma_trend", "rsi_reversion", "buyer_signal")
HURDLE, COST_BPS, WARM_UP = 0.04, 7.5, 253


def states(bars: DataFrame) -> DataFrame:
    """composite's rows with a 0 or 1 for each strategy: 12-1 momentum above zero, above the
    hurdle, the 50-row mean above the 200-row one, the pull-back position, the composite
    score between its two thresholds. One fold over a symbol's bars serves all five."""
    r = R.composite(bars).withColumn("score", F.round("score", 6))
    lag = lambda n: F.lag("close", n).over(by_symbol())
    mean = lambda n: R.full(F.avg("close").over(R.last(n)), "close", n)
    r = r.withColumns({"mom": F.round(F.try_divide(lag(21), lag(252)) - 1, 6), "fast": mean(50), "s200": mean(200), "s5": mean(5)})
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    r = r.withColumns({"relative_strength": flag(F.col("mom") > 0), "dual_momentum": flag(F.col("mom") > HURDLE), "sma_trend": flag(F.col("fast") > F.col("s200")), "buyer_signal": R.hysteresis(r, "score")})
    return R.with_rsi_position(r.withColumn("rsi", F.col("rsi_2")), "rsi_reversion")


def returns(bars: DataFrame) -> DataFrame:
    """(symbol, strategy, trade_date, x): the day's return of yesterday's state, less the cost
    of changes, after the warm-up; a row a strategy, made after all windows."""
    r = states(bars)
    held = {s: F.coalesce(F.lag(s).over(by_symbol()), F.lit(0)) for s in STRATEGIES}
    before = {s: F.coalesce(F.lag(s, 2).over(by_symbol()), F.lit(0)) for s in STRATEGIES}
    r = r.withColumns({f"x_{s}": held[s] * F.coalesce("ret", F.lit(0.0)) - F.abs(held[s] - before[s]) * COST_BPS / 1e4 for s in STRATEGIES}).where(F.col("rn") > WARM_UP)
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"x_{s}").alias("x")) for s in STRATEGIES])
    return r.select("symbol", "trade_date", F.inline(rows))


_OWN = {
    "relative_strength": f"SELECT symbol, trade_date, coalesce(mom_12_1 > 0, false)::INT AS state FROM ({SQL['w12_momentum']})",
    "dual_momentum": f"SELECT symbol, trade_date, coalesce(mom_12_1 > {HURDLE}, false)::INT AS state FROM ({SQL['w12_momentum']})",
    "sma_trend": f"SELECT symbol, trade_date, coalesce({full(f'avg(close) OVER {frame(50)}', 'close', 50)} > {full(f'avg(close) OVER {frame(200)}', 'close', 200)}, false)::INT AS state FROM bars",
    "rsi_reversion": f"SELECT symbol, trade_date, state FROM ({SQL['w15_rsi_position']})",
    "buyer_signal": f"SELECT symbol, trade_date, state FROM ({SQL['w14_hysteresis_signal']})",
}
OVER = "(PARTITION BY symbol, strategy ORDER BY trade_date)"
RETURNS = (
    "sa AS (" + " UNION ALL ".join(f"SELECT symbol, trade_date, '{k}' AS strategy, state FROM ({v})" for k, v in _OWN.items())
    + f"), sh AS (SELECT symbol, strategy, trade_date, rn, ret, coalesce(lag(state) OVER {OVER}, 0) AS held, coalesce(lag(state, 2) OVER {OVER}, 0) AS held2 FROM sa JOIN r USING (symbol, trade_date)), "
    f"sx AS (SELECT symbol, strategy, trade_date, held * coalesce(ret, 0) - abs(held - held2) * {COST_BPS} / 1e4 AS x FROM sh WHERE rn > {WARM_UP})"
)


@query("bt2_five_strategies", sql("r", ctes=RETURNS + ", t AS (SELECT symbol || '/' || strategy AS symbol, trade_date, x, exp(sum(ln(1 + x)) OVER (PARTITION BY symbol, strategy ORDER BY trade_date)) AS wealth FROM sx WHERE x > -1), " + PERF.format(x="x"), body=PERF_BODY.replace("SELECT symbol,", "SELECT split_part(symbol, '/', 1) AS symbol, split_part(symbol, '/', 2) AS strategy,"), recursive=True))
def bt2(spark, d) -> DataFrame:
    return C.perf_stats(returns(bars(spark, d)), ["symbol", "strategy"], "x", "trade_date")


#: Months back from the last date; None: all.
PERIODS = (("all", None), ("3y", 36), ("1y", 12), ("6m", 6), ("3m", 3))
POOLED = "po AS (SELECT strategy AS series, trade_date, round(avg(x), 9) AS x FROM sx GROUP BY ALL), bo AS (SELECT * FROM po UNION ALL SELECT 'benchmark', trade_date, bench_ret FROM br WHERE trade_date IN (SELECT trade_date FROM po)), lst AS (SELECT max(trade_date) AS l FROM bo), " + "cu AS (" + " UNION ALL ".join(f"SELECT '{k}' AS period, bo.* FROM bo, lst" + (f" WHERE trade_date >= (l - INTERVAL {m} MONTH)::DATE" if m else "") for k, m in PERIODS) + ")"


@query("bt6_strategies_by_period", sql("r", "br", ctes=RETURNS + ", " + POOLED + ", t AS (SELECT period || '/' || series AS symbol, trade_date, x, exp(sum(ln(1 + x)) OVER (PARTITION BY period, series ORDER BY trade_date)) AS wealth FROM cu WHERE x > -1), " + PERF.format(x="x") + f", out AS ({PERF_BODY}), o2 AS (SELECT split_part(symbol, '/', 1) AS period, split_part(symbol, '/', 2) AS series, * EXCLUDE (symbol) FROM out)", body="SELECT o2.*, round(o2.total - b.total, 6) AS excess, o2.total > b.total AS beats FROM o2 JOIN (SELECT period, total FROM o2 WHERE series = 'benchmark') b USING (period)", recursive=True))
def bt6(spark, d) -> DataFrame:
    """Each strategy over all symbols in equal parts, beside the benchmark on the same dates,
    for each period: statistics, the excess, and whether it beats the benchmark."""
    s = returns(bars(spark, d)).groupBy(F.col("strategy").alias("series"), "trade_date").agg(F.round(F.avg("x"), 9).alias("x")).cache()  # a row a strategy and date; read for each period
    b = bench_returns(bench(spark, d)).join(s.select("trade_date").distinct(), "trade_date", "left_semi").select(F.lit("benchmark").alias("series"), "trade_date", F.col("bench_ret").alias("x"))
    both = s.unionByName(b).cache()
    end = both.agg(F.max("trade_date")).scalar()
    cuts = [both.withColumn("period", F.lit(k)) if m is None else both.where(F.col("trade_date") >= F.add_months(end, -m)).withColumn("period", F.lit(k)) for k, m in PERIODS]
    g = C.perf_stats(reduce(DataFrame.unionByName, cuts), ["period", "series"], "x", "trade_date").cache()
    own = g.where("series = 'benchmark'").select("period", F.col("total").alias("b"))
    return g.join(own, "period").withColumns({"excess": F.round(F.col("total") - F.col("b"), 6), "beats": F.col("total") > F.col("b")}).drop("b")
