"""Registered queries: regression, tail tests, stress, strategies, model evaluation."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf, cdf_sql
from panelspark.operators import cross as C
from panelspark.operators import rolling as R
from panelspark.operators import resample, solve, stress
from panelspark.operators.asof import asof
from panelspark.plans.joins import MACRO, macro
from panelspark.plans.cross_sections import PERF as PERF_OF
from panelspark.plans.cross_sections import PERF_BODY
from panelspark.plans.panels import PAIRED, REC, SCORE, W
from panelspark.registry import query
from panelspark.sources.views import bars, bench, bench_returns, by_symbol, sectors, sql, with_returns


def paired(spark, d):
    r = with_returns(bars(spark, d)).join(bench_returns(bench(spark, d)), "trade_date")
    return r.where("ret IS NOT NULL AND bench_ret IS NOT NULL")


@query("st3_ols_beta", sql("r", "br", ctes=PAIRED, body="SELECT symbol, count(*) AS n, round(covar_samp(ret, bench_ret) / var_samp(bench_ret), 6) AS beta, round(avg(ret) - covar_samp(ret, bench_ret) / var_samp(bench_ret) * avg(bench_ret), 6) AS alpha, round(sqrt(greatest(0, var_samp(ret) - pow(covar_samp(ret, bench_ret), 2) / var_samp(bench_ret)) / (count(*) - 2) / var_samp(bench_ret)), 6) AS se FROM p GROUP BY symbol"))
def st3(spark, d):
    g = paired(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.covar_samp("ret", "bench_ret").alias("c"), F.var_samp("bench_ret").alias("vx"), F.var_samp("ret").alias("vy"), F.avg("ret").alias("my"), F.avg("bench_ret").alias("mx"))
    b = F.col("c") / F.col("vx")
    return R.tidy(g, "symbol", "n", beta=b, alpha=F.col("my") - b * F.col("mx"), se=F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - F.col("c") * F.col("c") / F.col("vx")) / (F.col("n") - 2) / F.col("vx")))


@query("st4_regime_betas", sql("r", "br", ctes=PAIRED, body="SELECT symbol, " + ", ".join(f"count(*) FILTER (bench_ret {o} 0) AS n_{k}, round(CASE WHEN count(*) FILTER (bench_ret {o} 0) >= 10 THEN covar_samp(ret, bench_ret) FILTER (bench_ret {o} 0) / var_samp(bench_ret) FILTER (bench_ret {o} 0) ELSE covar_samp(ret, bench_ret) / var_samp(bench_ret) END, 6) AS beta_{k}" for k, o in (("up", ">"), ("down", "<"))) + " FROM p GROUP BY symbol"))
def st4(spark, d):
    def part(ok):
        x, y = F.when(ok, F.col("bench_ret")), F.when(ok, F.col("ret"))
        return F.count_if(ok), F.round(F.when(F.count_if(ok) >= 10, F.covar_samp(y, x) / F.var_samp(x)).otherwise(F.covar_samp("ret", "bench_ret") / F.var_samp("bench_ret")), 6)

    (nu, bu), (nd, bd) = part(F.col("bench_ret") > 0), part(F.col("bench_ret") < 0)
    return paired(spark, d).groupBy("symbol").agg(nu.alias("n_up"), bu.alias("beta_up"), nd.alias("n_down"), bd.alias("beta_down"))


@query("st5_macro_regime_betas", sql("r", "br", ctes=PAIRED + ", " + MACRO + ", f AS (SELECT trade_date, v - lag(v, 63) OVER (ORDER BY trade_date) AS ch FROM bench ASOF LEFT JOIN macro ON trade_date >= obs_date), q AS (SELECT p.*, CASE WHEN ch > 0.25 THEN 'rising' WHEN ch < -0.25 THEN 'falling' ELSE 'steady' END AS regime FROM p JOIN f USING (trade_date) WHERE ch IS NOT NULL)", body="SELECT symbol, regime, count(*) AS n, round(covar_samp(ret, bench_ret) / var_samp(bench_ret), 6) AS beta FROM q GROUP BY ALL HAVING count(*) >= 60"))
def st5(spark, d):
    f = asof(bench(spark, d).select("trade_date").withColumn("one", F.lit(1)), "trade_date", macro(spark, d).withColumn("one", F.lit(1)), "obs_date", ["one"], ["v"])
    f = f.select("trade_date", (F.col("v") - F.lag("v", 63).over(Window.partitionBy("one").orderBy("trade_date"))).alias("ch")).where("ch IS NOT NULL")
    q = paired(spark, d).join(f, "trade_date").withColumn("regime", F.when(F.col("ch") > 0.25, "rising").when(F.col("ch") < -0.25, "falling").otherwise("steady"))
    g = q.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.covar_samp("ret", "bench_ret").alias("c"), F.var_samp("bench_ret").alias("v")).where("n >= 60")
    return R.tidy(g, "symbol", "regime", "n", beta=F.col("c") / F.col("v"))


@query("st2_dimson_beta")
def st2(spark, d):
    """Betas on the benchmark's day before, same day and day after, summed."""
    w = by_symbol()
    p = paired(spark, d).withColumns({"x0": F.lag("bench_ret").over(w), "x1": F.col("bench_ret"), "x2": F.lead("bench_ret").over(w)}).where("x0 IS NOT NULL AND x2 IS NOT NULL")
    return solve.grouped_ols(p, ["symbol"], "ret", ["x0", "x1", "x2"]).select("symbol", "n", F.round(F.col("coef")[1] + F.col("coef")[2] + F.col("coef")[3], 6).alias("beta"), F.round("r2", 6).alias("r2"))


def sector_names(spark, d) -> list[str]:
    return [r.sector for r in sectors(spark, d).where("sector IS NOT NULL").select("sector").distinct().orderBy("sector").collect()]  # a name a sector


def factor_panel(spark, d):
    """Paired returns with f0, f1, ...: the mean return of each sector in the table, by name,
    then the benchmark's return, its square and its lag."""
    r = paired(spark, d).join(sectors(spark, d), "symbol", "left")
    names = sector_names(spark, d)
    k = len(names)
    s = r.groupBy("trade_date").agg(*[F.coalesce(F.avg(F.when(F.col("sector") == x, F.col("ret"))), F.lit(0.0)).alias(f"f{i}") for i, x in enumerate(names)])
    return r.join(s, "trade_date").withColumns({f"f{k}": F.col("bench_ret"), f"f{k + 1}": F.col("bench_ret") * F.col("bench_ret"), f"f{k + 2}": F.lag("bench_ret").over(by_symbol())}).where(f"f{k + 2} IS NOT NULL")


def factor_names(panel) -> list[str]:
    return sorted((c for c in panel.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))


@query("st1_factor_exposures")
def st1(spark, d):
    """Regression on all factors with Newey-West errors."""
    p = factor_panel(spark, d)
    names = factor_names(p)
    out = solve.grouped_ols(p, ["symbol"], "ret", names, order="trade_date", newey_west=True)
    part = lambda c: F.transform(F.slice(c, 2, len(names)), lambda x: F.round(x, 6))
    return out.select("symbol", "n", F.round(F.col("coef")[0] * 252, 6).alias("alpha"), part("coef").alias("betas"), part("se").alias("errors"), F.round("r2", 6).alias("r2"))


HITS = f"h AS (SELECT symbol, trade_date, ret, CASE WHEN count(ret) OVER f = 250 THEN quantile_cont(ret, 0.01) OVER f END AS q FROM r WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)), k AS (SELECT *, (ret < q)::INT AS hit, lag((ret < q)::INT) OVER {W} AS prev FROM h WHERE q IS NOT NULL), c AS (SELECT symbol, count(*) AS n, sum(hit) AS x, count(*) FILTER (prev = 0 AND hit = 0) AS n00, count(*) FILTER (prev = 0 AND hit = 1) AS n01, count(*) FILTER (prev = 1 AND hit = 0) AS n10, count(*) FILTER (prev = 1 AND hit = 1) AS n11 FROM k GROUP BY symbol)"


def _xlog(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * ln({b}) ELSE 0 END"


POF = f"greatest(0, -2 * (({_xlog('(n - x)', '0.99')}) + ({_xlog('x', '0.01')}) - ({_xlog('(n - x)', '(1 - x / n)')}) - ({_xlog('x', 'x / n')})))"
PI, P0, P1 = "((n01 + n11) / (n00 + n01 + n10 + n11))", "(n01 / (n00 + n01))", "(n11 / nullif(n10 + n11, 0))"
IND = f"greatest(0, -2 * (({_xlog('(n00 + n10)', f'(1 - {PI})')}) + ({_xlog('(n01 + n11)', PI)}) - ({_xlog('n00', f'(1 - {P0})')}) - ({_xlog('n01', P0)}) - ({_xlog('n10', f'(1 - {P1})')}) - ({_xlog('n11', P1)})))"


@query("st11_st12_var_backtest", sql("r", ctes=HITS + f", l AS (SELECT *, {POF} AS pof, {IND} AS ind FROM c), l2 AS (SELECT *, round(2 * (1 - ({cdf_sql('sqrt(pof)')})), 6) AS p1, CASE WHEN n10 + n11 > 0 THEN round(2 * (1 - ({cdf_sql('sqrt(ind)')})), 6) END AS p2 FROM l WHERE n >= 50)", body=f"SELECT symbol, n, x::BIGINT AS breaches, round(pof, 6) AS pof, p1 AS pof_p, round(ind, 6) AS ind, p2 AS ind_p, CASE WHEN p1 >= 0.05 AND (p2 IS NULL OR p2 >= 0.05) THEN 'green' WHEN p1 >= 0.05 OR p2 >= 0.05 THEN 'amber' ELSE 'red' END AS light FROM l2"))
def st12(spark, d):
    """99 % value at risk of the 250 days before, tested: Kupiec's coverage and
    Christoffersen's independence."""
    r = with_returns(bars(spark, d))
    k = R.moments(r.select("symbol", "trade_date", "ret"), q=("quantile", "ret", -250, -1, 250, 0.01)).withColumn("hit", (F.col("ret") < F.col("q")).cast("int"))
    k = k.withColumn("prev", F.lag("hit").over(by_symbol()))
    pair = lambda a, b: F.count_if((F.col("prev") == a) & (F.col("hit") == b))
    # days without a full window have no hit
    c = k.groupBy("symbol").agg(F.count("hit").alias("n"), F.sum("hit").alias("x"), *[pair(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    xlog = lambda a, b: F.when(a > 0, a * F.ln(b)).otherwise(0.0)
    n, x, n00, n01, n10, n11 = (F.col(i) for i in ("n", "x", "n00", "n01", "n10", "n11"))
    pof = F.greatest(F.lit(0.0), -2 * (xlog(n - x, F.lit(0.99)) + xlog(x, F.lit(0.01)) - xlog(n - x, 1 - x / n) - xlog(x, x / n)))
    pi, p0, p1 = (n01 + n11) / (n00 + n01 + n10 + n11), n01 / (n00 + n01), F.try_divide(n11, n10 + n11)
    ind = F.greatest(F.lit(0.0), -2 * (xlog(n00 + n10, 1 - pi) + xlog(n01 + n11, pi) - xlog(n00, 1 - p0) - xlog(n01, p0) - xlog(n10, 1 - p1) - xlog(n11, p1)))
    c = c.withColumns({"pof": pof, "ind": ind}).where("n >= 50")
    p = lambda k: F.round(2 * (1 - cdf(F.sqrt(k))), 6)
    c = c.withColumns({"pof_p": p("pof"), "ind_p": F.when(n10 + n11 > 0, p("ind")), "breaches": x})
    good = lambda k: F.coalesce(F.col(k) >= 0.05, F.lit(False))
    light = F.when(good("pof_p") & (F.col("ind_p").isNull() | good("ind_p")), "green").when(good("pof_p") | good("ind_p"), "amber").otherwise("red")
    return c.select("symbol", "n", "breaches", light.alias("light"), F.round("pof", 6).alias("pof"), "pof_p", F.round("ind", 6).alias("ind"), "ind_p")


FORECASTS = REC + f", t AS (SELECT symbol, x0.ret * x0.ret AS rv, ewma_var AS fc, CASE WHEN count(x0.ret) OVER w = 60 THEN avg(x0.ret * x0.ret) OVER w END AS naive FROM x0 JOIN rs USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"


@query("st10_forecast_evaluation", sql("r", recursive=True, ctes=FORECASTS + ", g AS (SELECT symbol, count(*) AS n, avg(pow(rv - fc, 2)) AS mse, avg(pow(rv - naive, 2)) AS mse_naive, avg(rv / fc - ln(fc / rv) - 1) FILTER (rv > 0) AS qlike, avg(rv / naive - ln(naive / rv) - 1) FILTER (rv > 0) AS qlike_naive FROM t WHERE fc > 0 AND naive > 0 AND rv IS NOT NULL GROUP BY symbol)", body="SELECT symbol, n, round(mse, 6) AS mse, round(mse_naive, 6) AS mse_naive, round(qlike, 6) AS qlike, round(qlike_naive, 6) AS qlike_naive, round(qlike, 6) < round(qlike_naive, 6) AS beats_naive FROM g"))
def st10(spark, d):
    """The exponential variance forecast against squared returns, beside the mean of the 60
    days before; both are made the day before."""
    r = with_returns(bars(spark, d)).withColumn("rv", F.col("ret") * F.col("ret"))
    r = R.recursive(r.withColumn("naive", R.full(F.avg("rv").over(R.before(60)), "ret", 60, R.before(60)))).where("ewma_var > 0 AND naive > 0 AND rv IS NOT NULL")
    sq = lambda c: F.avg(F.pow(F.col("rv") - F.col(c), F.lit(2)))
    ql = lambda c: F.avg(F.when(F.col("rv") > 0, F.col("rv") / F.col(c) - F.ln(F.col(c) / F.col("rv")) - 1))
    g = r.groupBy("symbol").agg(F.count("*").alias("n"), *[F.round(f(c), 6).alias(k) for f, c, k in ((sq, "ewma_var", "mse"), (sq, "naive", "mse_naive"), (ql, "ewma_var", "qlike"), (ql, "naive", "qlike_naive"))])
    return g.withColumn("beats_naive", F.col("qlike") < F.col("qlike_naive"))


#: (name, start, trough, end, shocks): the last begins before the panel does.
SCENARIOS = (
    ("s1", "1993-01-04", "1993-03-31", "1993-06-30", {"market": -0.34}), ("s2", "1995-03-01", "1995-08-31", "1995-12-29", {"market": -0.25}),
    ("s3", "1997-07-01", "1997-12-31", "1998-03-31", {"market": -0.19}), ("s0", "1990-07-02", "1990-10-11", "1991-02-13", {"market": -0.20}),
)
STRESS = (
    "sc(scenario, a, t, e, shock) AS (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{t}', DATE '{e}', {x['market']}::DOUBLE)" for k, a, t, e, x in SCENARIOS) + "), sp AS (SELECT symbol, min(trade_date) AS f, max(trade_date) AS l FROM bars GROUP BY 1), "
    "g AS (SELECT scenario, symbol, count(*) FILTER (trade_date <= t + 5) AS n, max(close) FILTER (trade_date <= t + 5) AS hi, min(close) FILTER (trade_date <= t + 5) AS lo, count(*) FILTER (trade_date BETWEEN t AND e + 7) AS later, arg_max(close, trade_date) FILTER (trade_date BETWEEN t AND e + 7) AS fin FROM bars JOIN sc ON trade_date BETWEEN a - 5 AND greatest(t + 5, e + 7) GROUP BY ALL), "
    + PAIRED + ", be AS (SELECT symbol, covar_samp(ret, bench_ret) / nullif(var_samp(bench_ret), 0) AS beta FROM p GROUP BY symbol HAVING count(*) >= 60), "
    "o AS (SELECT sp.symbol, sc.*, l, lo, hi, fin, later, coalesce(f <= a + 7 AND l >= t - 7 AND n >= 2, false) AS covers, beta * shock AS implied FROM sp CROSS JOIN sc LEFT JOIN g USING (scenario, symbol) LEFT JOIN be USING (symbol))"
)


def market_loadings(spark, d):
    """(symbol, factor, beta): betas to the benchmark of symbols with 60 common days."""
    g = paired(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("ret", "bench_ret"), F.var_samp("bench_ret")).alias("beta"))
    return g.where("n >= 60").select("symbol", F.lit("market").alias("factor"), "beta")


@query("st13_stress_scenarios", sql("r", "br", ctes=STRESS, body="SELECT symbol, scenario, CASE WHEN covers THEN 'historical replay' WHEN implied IS NOT NULL THEN 'factor-implied' ELSE 'insufficient history' END AS method, round(CASE WHEN covers THEN (lo / hi - 1) * 100 ELSE implied * 100 END, 2) AS drop_pct, round(CASE WHEN covers AND later >= 2 AND l >= e - 7 THEN (fin / lo - 1) * 100 END, 2) AS recovery_pct FROM o"))
def st13(spark, d):
    return stress.replay(bars(spark, d), list(SCENARIOS), market_loadings(spark, d))


@query("st8_tail_counts", sql("r", ctes="lv(level) AS (VALUES (0.95::DOUBLE), (0.99::DOUBLE)), q AS (SELECT symbol, level, count(ret) AS n, CASE WHEN level < 0.97 THEN quantile_cont(ret, 0.05) ELSE quantile_cont(ret, 0.01) END AS q FROM r, lv GROUP BY symbol, level HAVING count(ret) >= 100)", body="SELECT symbol, level, any_value(n) AS n, round(-any_value(q), 6) AS value_at_risk, round(-avg(ret), 6) AS shortfall, count(*) AS tail, count(*) < 30 AS low_confidence FROM q JOIN r USING (symbol) WHERE ret <= q + 1e-12 GROUP BY symbol, level"))
def st8_counts(spark, d):
    """What of st8_tail_with_bootstrap isn't drawn."""
    t = resample.tail_risk(with_returns(bars(spark, d)), replicates=1)
    return R.tidy(t, "symbol", "level", "n", "tail", "low_confidence", value_at_risk=F.col("value_at_risk"), shortfall=F.col("shortfall"))


@query("st8_tail_with_bootstrap")
def st8(spark, d):
    t = resample.tail_risk(with_returns(bars(spark, d)))
    return R.tidy(t, "symbol", "level", "n", "tail", "low_confidence", **{k: F.col(k) for k in ("value_at_risk", "shortfall", "low", "high")})


@query("st9_garch_grid")
def st9(spark, d):
    g = resample.garch(with_returns(bars(spark, d)))
    return R.tidy(g, "symbol", "n", **{k: F.col(k) for k in ("omega", "alpha", "beta", "persistence", "log_likelihood", "next_vol")})


def expected_maximum(trials: int) -> float:
    """Of as many independent standard normal Sharpe ratios (Bailey and Lopez de Prado)."""
    if trials <= 1:
        return 0.0
    z, g = NormalDist().inv_cdf, 0.5772156649015329
    return (1 - g) * z(1 - 1 / trials) + g * z(1 - 1 / (trials * math.e))


TRIALS = 20
DEFLATED = "g AS (SELECT symbol, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS g1, kurtosis(ret) + 3 AS g2 FROM r GROUP BY symbol HAVING count(ret) >= 4), z AS (SELECT *, sqrt(greatest(1e-12, (1 - g1 * sr + (g2 - 1) / 4 * sr * sr) / (n - 1))) AS s FROM g)"


def unbiased(n, skew, kurt):
    """Sample-corrected skewness and excess kurtosis from the population's."""
    n = n.cast("double")
    return F.sqrt(n * (n - 1)) / (n - 2) * skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)


@query("st7_deflated_sharpe", sql("r", ctes=DEFLATED, body=f"SELECT symbol, n, {TRIALS} AS trials, round(sr * sqrt(252), 6) AS sharpe, round({cdf_sql('(sr / s)')}, 6) AS psr, round({cdf_sql(f'(sr / s - {expected_maximum(TRIALS)!r}::DOUBLE)')}, 6) AS deflated FROM z"))
def st7(spark, d):
    """Probability that the Sharpe ratio is above zero, and above the greatest that TRIALS
    worthless strategies would show, corrected for skewness and kurtosis."""
    g = with_returns(bars(spark, d)).groupBy("symbol").agg(F.count("ret").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2")).where("n >= 4")
    skew, kurt = unbiased(F.col("n"), F.col("g1"), F.col("g2"))
    sr = F.col("sr")
    g = g.withColumn("z", sr / F.sqrt(F.greatest(F.lit(1e-12), (1 - skew * sr + (kurt + 2) / 4 * sr * sr) / (F.col("n") - 1)))).withColumn("trials", F.lit(TRIALS))
    return R.tidy(g, "symbol", "n", "trials", sharpe=sr * R.YEAR, psr=cdf(F.col("z")), deflated=cdf(F.col("z") - expected_maximum(TRIALS)))


SIGNAL = SCORE + f", e AS (SELECT *, CASE WHEN round(score, 6) >= 65 THEN 1 WHEN round(score, 6) < 45 THEN 0 END AS ev FROM sc), sg AS (SELECT symbol, trade_date, ret, coalesce(last_value(ev IGNORE NULLS) OVER {W}, 0) AS state FROM e), h AS (SELECT *, coalesce(lag(state) OVER {W}, 0) AS held, coalesce(lag(state, 2) OVER {W}, 0) AS held2 FROM sg), st AS (SELECT symbol, trade_date, held, held * coalesce(ret, 0) - abs(held - held2) * 10 / 1e4 AS x FROM h)"


def strategy(spark, d):
    r = R.composite(bars(spark, d), keep=("rn",)).select("symbol", "trade_date", "ret", "rn", F.round("score", 6).alias("score"))
    r = r.withColumn("state", R.hysteresis(r, "score", 65, 45))
    return R.strategy_returns(r)


PERF = f"t AS (SELECT *, exp(sum(ln(1 + x)) OVER {W}) AS wealth FROM st WHERE x > -1), " + PERF_OF.format(x="x")


@query("bt2_bt3_strategy_performance", sql("r", recursive=True, ctes=SIGNAL + ", " + PERF, body=PERF_BODY))
def bt3(spark, d):
    return C.perf_stats(strategy(spark, d), ["symbol"], "strat_ret", "trade_date")


@query("bt4_walk_forward_folds", sql("r", recursive=True, ctes=SIGNAL + f", k AS (SELECT *, row_number() OVER {W} AS rn FROM st), fo AS (SELECT symbol, ((rn - 253) // 63)::INT AS fold, x FROM k WHERE rn > 252)", body="SELECT symbol, fold, count(*) AS n, round(sum(x), 6) AS total, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 6) AS sharpe FROM fo GROUP BY ALL"))
def bt4(spark, d):
    s = strategy(spark, d).where("rn > 252").withColumn("fold", F.floor((F.col("rn") - 253) / 63).cast("int"))
    return s.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.round(F.sum("strat_ret"), 6).alias("total"), F.round(F.try_divide(F.avg("strat_ret"), F.stddev_samp("strat_ret")) * R.YEAR, 6).alias("sharpe"))


@query("a25_trade_ledger", sql("r", recursive=True, ctes=SIGNAL + f", c AS (SELECT *, CASE WHEN held <> lag(held) OVER {W} THEN 1 ELSE 0 END AS ch FROM st), n AS (SELECT *, sum(ch) OVER {W} AS run FROM c), tr AS (SELECT symbol, run, sum(x) AS pl, count(*) AS days FROM n WHERE held = 1 GROUP BY ALL)", body="SELECT symbol, count(*) AS trades, round(avg((pl > 0)::INT), 6) AS win_rate, round(sum(greatest(pl, 0)) / nullif(-sum(least(pl, 0)), 0), 6) AS profit_factor, sum(days)::BIGINT AS days_held FROM tr GROUP BY symbol"))
def a25(spark, d):
    t = R.runs(strategy(spark, d), "held").where("held = 1").groupBy("symbol", "run").agg(F.sum("strat_ret").alias("pl"), F.count("*").alias("days"))
    g = t.groupBy("symbol").agg(F.count("*").alias("trades"), F.avg((F.col("pl") > 0).cast("int")).alias("w"), F.sum(F.greatest("pl", F.lit(0.0))).alias("up"), F.sum(F.least("pl", F.lit(0.0))).alias("down"), F.sum("days").alias("days_held"))
    return R.tidy(g, "symbol", "trades", "days_held", win_rate=F.col("w"), profit_factor=F.try_divide("up", -F.col("down")))


ROTATE = f"m AS (SELECT symbol, trade_date, ret, lag(close, 21) OVER {W} / lag(close, 126) OVER {W} - 1 AS mo FROM r), ds AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM bench), rb AS (SELECT symbol, k // 21 AS b, trade_date AS rd FROM m JOIN ds USING (trade_date) WHERE k % 21 = 0 AND mo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY round(mo, 9) DESC, symbol) <= 5)"


@query("bt1_rotation", sql("r", "bench", ctes=ROTATE, body="SELECT m.trade_date, count(ret) AS names, round(sum(ret) / 5, 6) AS ret FROM m JOIN ds USING (trade_date) JOIN rb ON rb.symbol = m.symbol AND rb.b = (k - 1) // 21 WHERE ret IS NOT NULL GROUP BY m.trade_date"))
def bt1(spark, d):
    """The five with most momentum at every 21st session, a fifth each, held until the
    next; a name without a bar that day adds nothing."""
    r, w = with_returns(bars(spark, d)), by_symbol()
    m = r.withColumn("mo", F.lag("close", 21).over(w) / F.lag("close", 126).over(w) - 1)
    ds = bench(spark, d).select("trade_date", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")).alias("k"))
    m = m.join(ds, "trade_date")
    top = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc(F.round("mo", 9)), "symbol"))
    rb = m.where("k % 21 = 0 AND mo IS NOT NULL").withColumn("p", top).where("p <= 5").select("symbol", F.expr("k div 21").alias("b"))
    held = m.where("ret IS NOT NULL").withColumn("b", F.expr("(k - 1) div 21")).join(rb, ["symbol", "b"])
    return held.groupBy("trade_date").agg(F.count("ret").alias("names"), F.round(F.sum("ret") / 5, 6).alias("ret"))


@query("bt5_permutation_test")
def bt5(spark, d):
    return R.tidy(resample.permutation_test(bars(spark, d)), "symbol", "n", **{k: F.col(k) for k in ("sharpe", "null_mean", "null_sd", "p")})


@query("a43_a44_label_evaluation", sql("r", ctes=f"t AS (SELECT symbol, trade_date, (ret > 0)::INT AS y, CASE WHEN lag(ret) OVER {W} IS NOT NULL THEN greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 1 / (1 + exp(-5 * lag(ret) OVER {W})))) END AS p FROM r), u AS (SELECT * FROM t WHERE p IS NOT NULL)", body="SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM u GROUP BY 1"))
def a44(spark, d):
    r = with_returns(bars(spark, d))
    u = r.select((F.col("ret") > 0).cast("int").alias("y"), F.when(F.lag("ret").over(by_symbol()).isNotNull(), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), 1 / (1 + F.exp(-5 * F.lag("ret").over(by_symbol())))))).alias("p")).where("p IS NOT NULL")
    ll = -F.avg(F.when(F.col("y") == 1, F.ln("p")).otherwise(F.ln(1 - F.col("p"))))
    return u.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("rate"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))), 6).alias("brier"), F.round(ll, 6).alias("log_loss"))


@query("ml2_purged_folds", sql("bars", ctes="ds AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars)), f AS (SELECT trade_date, k, n, floor(k * 5 / n)::INT AS fold FROM ds), g AS (SELECT fold, min(k) AS lo, max(k) AS hi FROM f GROUP BY fold)", body="SELECT g.fold, count(*) FILTER (f.fold = g.fold) AS test_days, count(*) FILTER (f.k < g.lo - 10 OR f.k > g.hi + 20) AS train_days FROM f, g GROUP BY g.fold"))
def ml2(spark, d):
    w = Window.partitionBy(F.lit(1))
    f = bars(spark, d).select("trade_date").distinct().withColumns({"k": F.row_number().over(w.orderBy("trade_date")) - 1, "n": F.count("*").over(w)}).withColumn("fold", F.floor(F.col("k") * 5 / F.col("n")).cast("int"))
    g = f.groupBy("fold").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    pairs = f.select("k", F.col("fold").alias("own")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(g, "fold")
    return pairs.groupBy("fold").agg(F.count_if(F.col("own") == F.col("fold")).alias("test_days"), F.count_if((F.col("k") < F.col("lo") - 10) | (F.col("k") > F.col("hi") + 20)).alias("train_days"))
