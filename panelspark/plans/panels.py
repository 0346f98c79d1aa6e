"""Registered queries: per-symbol windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import rolling as R
from panelspark.registry import query
from panelspark.sources.views import bars, bench, bench_returns, sql, with_returns

W = "(PARTITION BY symbol ORDER BY trade_date)"


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(value: str, of: str, n: int, over: str | None = None) -> str:
    return f"CASE WHEN count({of}) OVER {over or frame(n)} >= {n} THEN {value} END"


@query("w1_returns", sql("r", body="SELECT symbol, trade_date, round(ret, 6) AS ret, round(log_ret, 6) AS log_ret FROM r"))
def w1(spark, d):
    return R.tidy(with_returns(bars(spark, d)), "symbol", "trade_date", ret=F.col("ret"), log_ret=F.col("log_ret"))


DAILY = """m AS (SELECT *, close * volume AS dollar_volume FROM r {where}),
m2 AS (SELECT *, stddev_samp(log_ret) OVER w20 * sqrt(252) AS vol, avg(dollar_volume) OVER w20 AS avg_dollar_volume, max(high) OVER w252 AS high_52w, min(low) OVER w252 AS low_52w
 FROM m WINDOW w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), w252 AS (PARTITION BY symbol ORDER BY trade_date ROWS 251 PRECEDING))"""
DAILY_BODY = """SELECT symbol, trade_date, volume, dense_rank() OVER (PARTITION BY trade_date ORDER BY ret DESC NULLS LAST) AS return_rank,
 dense_rank() OVER (PARTITION BY trade_date ORDER BY dollar_volume DESC NULLS LAST) AS volume_rank, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close,
 round(ret, 6) AS ret, round(log_ret, 6) AS log_ret, round(vol, 6) AS vol, round(avg_dollar_volume, 6) AS avg_dollar_volume, round(high_52w, 6) AS high_52w, round(low_52w, 6) AS low_52w,
 round(CASE WHEN high_52w > 0 THEN (close - high_52w) / high_52w ELSE 0 END, 6) AS drawdown_52w FROM m2"""


@query("w2_w3_r1_daily_metrics", sql("r", ctes=DAILY.format(where=""), body=DAILY_BODY))
def daily(spark, d):
    return R.daily_metrics(bars(spark, d))


@query("pf2_metrics_in_range", "WITH " + sql("bars", body="").split("WITH ", 1)[1].strip().rstrip(",") + ", r AS (SELECT *, lag(close) OVER w AS prev_close, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS log_ret FROM bars WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND symbol IN ('S000001', 'S000002', 'S000003') WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)), " + DAILY.format(where="") + DAILY_BODY)
def metrics_in_range(spark, d):
    return R.daily_metrics(bars(spark, d), start="1995-01-01", end="1996-12-31", symbols=["s000001", "s000002", "s000003"])


@query("w4_vol_term_structure", sql("r", ctes="t AS (SELECT symbol, trade_date, " + ", ".join(full(f"stddev_samp(log_ret) OVER {frame(n)} * sqrt(252)", "log_ret", n) + f" AS v{n}" for n in (5, 21, 63, 126, 252)) + " FROM r)", body="SELECT symbol, trade_date, " + ", ".join(f"round(v{n}, 6) AS vol_{n}d" for n in (5, 21, 63, 126, 252)) + ", round(v21 / nullif(v252, 0), 6) AS slope FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1"))
def w4(spark, d):
    return R.vol_term_structure(bars(spark, d))


@query("w5_drawdown", sql("bars", body=f"SELECT symbol, trade_date, round(max(close) OVER {W}, 6) AS peak, round(close / max(close) OVER {W} - 1, 6) AS drawdown FROM bars"))
def w5(spark, d):
    return R.drawdowns(bars(spark, d))


@query("w6_growth", sql("r", body=f"SELECT symbol, trade_date, round(exp(sum(coalesce(ln(1 + ret), 0)) OVER {W}), 6) AS growth FROM r"))
def w6(spark, d):
    return R.growth(bars(spark, d))


@query("w8_session_changes", sql("bars", body="SELECT symbol, trade_date, " + ", ".join(f"round(close / lag(close, {n}) OVER {W} - 1, 6) AS chg_{n}" for n in (1, 2, 3, 4, 5, 21, 63)) + " FROM bars"))
def w8(spark, d):
    return R.session_changes(bars(spark, d))


@query("w9_latest_rows", sql("bars", body="SELECT symbol, trade_date, volume, round(close, 6) AS close, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM bars QUALIFY age <= 25"))
def w9(spark, d):
    return R.latest(bars(spark, d), 25).select("symbol", "trade_date", "volume", F.round("close", 6).alias("close"), "age")


@query("w10_forward_returns", sql("bars", body="SELECT symbol, trade_date, " + ", ".join(f"round(lead(close, {h}) OVER {W} / close - 1, 6) AS fwd_{h}" for h in (1, 5, 21)) + " FROM bars"))
def w10(spark, d):
    return R.forward_returns(bars(spark, d))


def _bands_sql() -> str:
    m, s = f"avg(close) OVER {frame(20)}", f"stddev_samp(close) OVER {frame(20)}"
    sma = lambda k: full(f"avg(close) OVER {frame(k)}", "close", k)
    return f"""SELECT symbol, trade_date, round({sma(10)}, 6) AS sma_fast, round({sma(50)}, 6) AS sma_slow, round({sma(10)} / {sma(50)} - 1, 6) AS sma_spread, round(close / {sma(50)} - 1, 6) AS sma_distance,
 round({full(f'4 * {s} / nullif({m}, 0)', 'close', 20)}, 6) AS width, round({full(f'(close - ({m} - 2 * {s})) / nullif(4 * {s}, 0)', 'close', 20)}, 6) AS pct_b,
 round({full(f'(volume - avg(volume) OVER {frame(20)}) / nullif(stddev_samp(volume) OVER {frame(20)}, 0)', 'volume', 20)}, 6) AS volume_z FROM bars"""


@query("w11_bands", sql("bars", body=_bands_sql()))
def w11(spark, d):
    return R.bands(bars(spark, d))


@query("w12_momentum", sql("r", ctes=f"t AS (SELECT *, lag(close, 21) OVER {W} / lag(close, 252) OVER {W} - 1 AS m, {full(f'stddev_samp(ret) OVER {frame(252)} * sqrt(252)', 'ret', 252)} AS v FROM r)", body=f"SELECT symbol, trade_date, round(m, 6) AS mom_12_1, " + ", ".join(f"round(close / lag(close, {n}) OVER {W} - 1, 6) AS {k}" for k, n in (("mom_6m", 126), ("mom_3m", 63), ("mom_1m", 21))) + ", round(v, 6) AS vol, round(m / nullif(v, 0), 6) AS risk_adjusted, round(m, 6) > 0 AS passes FROM t"))
def w12(spark, d):
    return R.momentum(bars(spark, d))


TREND = f"t AS (SELECT symbol, trade_date, {full(f'(close > avg(close) OVER {frame(50)})::INT', 'close', 50)} AS state FROM bars)"


def trend(spark, d):
    b = bars(spark, d)
    return b.select("symbol", "trade_date", R.full((F.col("close") > F.avg("close").over(R.last(50))).cast("int"), "close", 50).alias("state"))


@query("w13_position_runs", sql("bars", ctes=TREND + f", u AS (SELECT *, CASE WHEN coalesce(state::VARCHAR, '?') <> lag(coalesce(state::VARCHAR, '?')) OVER {W} THEN 1 ELSE 0 END AS c FROM t), v AS (SELECT *, sum(c) OVER {W} AS run FROM u)", body="SELECT symbol, run::BIGINT AS run, state, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS length FROM v GROUP BY symbol, run, state"))
def w13(spark, d):
    return R.spans(trend(spark, d))


#: Folds over a symbol's bars, a row a step (see operators.rolling.recursive).
REC = """x0 AS MATERIALIZED (SELECT symbol, trade_date, close, ret, prev_close, rn, greatest(close - prev_close, 0) AS up, greatest(prev_close - close, 0) AS dn, lag(ret) OVER w AS pr, count(*) OVER s AS len, var_samp(ret) FILTER (rn <= 61) OVER s AS seed,
 greatest(high - low, coalesce(abs(high - prev_close), 0), coalesce(abs(low - prev_close), 0)) AS tr FROM r WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), s AS (PARTITION BY symbol)),
rec AS (SELECT symbol, rn, close AS e8, close AS e12, close AS e21, close AS e26, 0::DOUBLE AS sg, NULL::DOUBLE AS u2, NULL::DOUBLE AS d2, NULL::DOUBLE AS u14, NULL::DOUBLE AS d14, NULL::DOUBLE AS pu, NULL::DOUBLE AS pd, tr AS atr, NULL::DOUBLE AS ev FROM x0 WHERE rn = 1
 UNION ALL SELECT x.symbol, x.rn, close * 2 / 9 + e8 * 7 / 9, close * 2 / 13 + e12 * 11 / 13, close * 2 / 22 + e21 * 20 / 22, close * 2 / 27 + e26 * 25 / 27, (close * 2 / 13 + e12 * 11 / 13 - close * 2 / 27 - e26 * 25 / 27) * 0.2::DOUBLE + sg * 0.8::DOUBLE,
 coalesce(u2 / 2, 0) + up, coalesce(d2 / 2, 0) + dn, coalesce(u14 * 13 / 14, 0) + up, coalesce(d14 * 13 / 14, 0) + dn, coalesce(up / 14 + pu * 13 / 14, up), coalesce(dn / 14 + pd * 13 / 14, dn), tr / 14 + atr * 13 / 14,
 CASE WHEN x.rn = 62 AND len >= 61 THEN seed WHEN x.rn > 62 THEN 0.94::DOUBLE * ev + 0.06::DOUBLE * pr * pr END FROM rec JOIN x0 x ON x.symbol = rec.symbol AND x.rn = rec.rn + 1),
rs AS (SELECT symbol, rn, e8 AS ema_8, e12 AS ema_12, e21 AS ema_21, e26 AS ema_26, e12 - e26 - sg AS macd_hist, CASE WHEN rn > 2 AND d2 > 0 THEN 100 - 100 / (1 + u2 / d2) ELSE 50 END AS rsi_2, CASE WHEN rn > 14 AND d14 > 0 THEN 100 - 100 / (1 + u14 / d14) ELSE 50 END AS rsi_14,
 100 - 100 / (1 + pu / nullif(pd, 0)) AS rsi_14_plain, atr AS atr_14, ev AS ewma_var FROM rec)"""
SCORE = REC + f""", s AS (SELECT *, close / CASE WHEN rn >= 50 THEN avg(close) OVER {frame(200)} END - 1 AS t1, close / CASE WHEN rn >= 20 THEN avg(close) OVER {frame(50)} END - 1 AS t2, close / lag(close, 63) OVER {W} - 1 AS mo,
 CASE WHEN count(ret) OVER {frame(20)} >= 10 THEN stddev_samp(ret) OVER {frame(20)} * sqrt(252) END AS v, CASE WHEN count(ret) OVER {frame(252)} >= 50 THEN quantile_cont(ret, 0.5) OVER {frame(252)} * sqrt(252) END AS usual FROM r),
sc AS (SELECT symbol, trade_date, s.ret, s.rn, coalesce(least(100, greatest(0, 50 + 45 * (CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN
 0.4::DOUBLE * (0.45::DOUBLE * greatest(-1, least(1, t1 / 0.15)) + 0.35::DOUBLE * greatest(-1, least(1, t2 / 0.1)) + 0.2::DOUBLE * greatest(-1, least(1, (ema_8 / ema_21 - 1) / 0.05)))
 + 0.35::DOUBLE * (0.5::DOUBLE * greatest(-1, least(1, (rsi_14 - 50) / 25)) + 0.5::DOUBLE * CASE WHEN mo IS NULL THEN 0 ELSE greatest(-1, least(1, mo / 0.2)) END)
 + 0.25::DOUBLE * CASE WHEN v IS NULL OR nullif(usual, 0) IS NULL THEN 0 ELSE greatest(-1, least(1, 1.5 - v / (usual + 1e-8::DOUBLE))) END ELSE 0 END))), 50) AS score FROM s JOIN rs USING (symbol, rn))"""


@query("w25_composite_score", sql("r", ctes=SCORE, body="SELECT symbol, trade_date, round(score, 6) AS score FROM sc", recursive=True))
def w25(spark, d):
    return R.tidy(R.composite(bars(spark, d)), "symbol", "trade_date", score=F.col("score"))


@query("w14_hysteresis_signal", sql("r", ctes=SCORE + ", e AS (SELECT *, CASE WHEN round(score, 6) >= 55 THEN 1 WHEN round(score, 6) < 45 THEN 0 END AS ev FROM sc)", body=f"SELECT symbol, trade_date, coalesce(last_value(ev IGNORE NULLS) OVER {W}, 0) AS state FROM e", recursive=True))
def w14(spark, d):
    r = R.composite(bars(spark, d)).withColumn("score", F.round("score", 6))
    return r.select("symbol", "trade_date", R.hysteresis(r, "score").alias("state"))


@query("r11_rsi", sql("r", ctes=REC, body="SELECT symbol, trade_date, round(rsi_2, 6) AS rsi FROM x0 JOIN rs USING (symbol, rn)", recursive=True))
def r11(spark, d):
    return R.tidy(R.rsi(bars(spark, d)), "symbol", "trade_date", rsi=F.col("rsi"))


UNIVERSE = f", u0 AS (SELECT sc.symbol, trade_date, score, {full(f'avg(close) OVER {frame(10)}', 'close', 10)} / {full(f'avg(close) OVER {frame(50)}', 'close', 50)} - 1 AS spread, CASE WHEN rn > 200 THEN CASE WHEN close > avg(close) OVER {frame(200)} THEN 100 - rsi_2 ELSE -rsi_2 END END AS rsi_score FROM sc JOIN (SELECT symbol, rn, close FROM r) USING (symbol, rn) JOIN rs USING (symbol, rn)), u AS (SELECT symbol, round(spread, 6) AS sma_spread, round(rsi_score, 6) AS rsi_score, round(score, 6) AS composite FROM u0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)"


@query("r11_score_universes", sql("r", ctes=SCORE + UNIVERSE, body="SELECT *, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN row_number() OVER (ORDER BY {c} DESC NULLS LAST, symbol) END AS {c}_place" for c in ("sma_spread", "rsi_score", "composite")) + " FROM u", recursive=True))
def r11_universes(spark, d):
    """Each symbol's latest scores (spread of the 10- and 50-row means; 100 less RSI over the
    200-row mean, minus RSI under it; composite) and its place in each."""
    from pyspark.sql import Window

    u = R.latest(scored(spark, d), 1)
    u = R.tidy(u, "symbol", sma_spread=F.col("spread"), rsi_score=F.col("rsi_score"), composite=F.col("score"))
    place = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(c), "symbol"))).alias(f"{c}_place")  # noqa: E731  a row a symbol
    return u.select("*", *[place(c) for c in ("sma_spread", "rsi_score", "composite")])


def scored(spark, d):
    """The composite's rows with the mean spread and the RSI score."""
    r = R.composite(bars(spark, d), sma_10=R.over("avg", "close", 10), sma_50=R.over("avg", "close", 50), mean_200=R.over("avg", "close", 200, 1))
    side = F.when(F.col("close") > F.col("mean_200"), 100 - F.col("rsi_2")).otherwise(-F.col("rsi_2"))
    return r.withColumns({"spread": F.try_divide("sma_10", "sma_50") - 1, "rsi_score": F.when(F.col("rn") > 200, side)})


STATE = f""", y AS MATERIALIZED (SELECT x0.symbol, trade_date, x0.rn, x0.rn > 200 AS ready, close > avg(close) OVER {frame(200)} AND rsi_2 < 15 AS enter, rsi_2 > 70 OR close > avg(close) OVER {frame(5)} AS leave FROM x0 JOIN rs USING (symbol, rn)),
st AS (SELECT symbol, rn, 0 AS state FROM y WHERE rn = 1 UNION ALL SELECT y.symbol, y.rn, CASE WHEN NOT ready THEN state WHEN state = 1 THEN (NOT leave)::INT ELSE enter::INT END FROM st JOIN y ON y.symbol = st.symbol AND y.rn = st.rn + 1)"""


@query("w15_rsi_position", sql("r", ctes=REC + STATE, body="SELECT symbol, trade_date, CASE WHEN ready THEN state ELSE 0 END AS state FROM st JOIN y USING (symbol, rn)", recursive=True))
def w15(spark, d):
    return R.rsi_position(bars(spark, d))


FOLDS = ("ema_12", "ema_26", "macd_hist", "rsi_14", "atr_14")


@query("w16_exponential_means", sql("r", ctes=REC, body="SELECT symbol, trade_date, " + ", ".join(f"round({c}, 6) AS {c}" for c in FOLDS) + " FROM x0 JOIN rs USING (symbol, rn)", recursive=True))
def w16(spark, d):
    return R.tidy(R.recursive(with_returns(bars(spark, d))), "symbol", "trade_date", **{c: F.col(c) for c in FOLDS})


@query("w17_ewma_variance", sql("r", ctes=REC, body="SELECT symbol, trade_date, round(sqrt(ewma_var * 252), 6) AS ewma_vol FROM x0 JOIN rs USING (symbol, rn) WHERE ewma_var IS NOT NULL", recursive=True))
def w17(spark, d):
    """The day's forecast, made the day before: decay 0.94, from the first 60 returns."""
    return R.tidy(R.recursive(with_returns(bars(spark, d))).where("ewma_var IS NOT NULL"), "symbol", "trade_date", ewma_vol=F.sqrt(F.col("ewma_var") * 252))


def _range_sql() -> str:
    k = 0.34 / (1.34 + 21 / 19)
    yz = f"var_samp(o) OVER {frame(20)} + {k!r}::DOUBLE * var_samp(c) OVER {frame(20)} + (1 - {k!r}::DOUBLE) * avg(rs) OVER {frame(20)}"
    return f"SELECT symbol, trade_date, round({full(f'stddev_samp(log_ret) OVER {frame(20)} * sqrt(252)', 'log_ret', 20)}, 6) AS close_vol, round({full(f'sqrt(greatest(avg(gk) OVER {frame(20)}, 0) * 252)', 'gk', 20)}, 6) AS gk_vol, round({full(f'sqrt(greatest({yz}, 0) * 252)', 'o', 20)}, 6) AS yz_vol FROM y"


@query("w18_range_vols", sql("r", ctes="x AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS c, ln(open / prev_close) AS o, ln(high / open) AS u, ln(low / open) AS dn FROM r), y AS (SELECT *, 0.5 * hl * hl - 0.3862943611198906::DOUBLE * c * c AS gk, u * (u - c) + dn * (dn - c) AS rs FROM x)", body=_range_sql()))
def w18(spark, d):
    return R.range_vols(bars(spark, d))


@query("w19_tail_risk", sql("r", ctes="t AS (SELECT symbol, trade_date, " + full(f"quantile_cont(ret, 0.05) OVER {frame(252)}", "ret", 252) + " AS q5, " + full(f"quantile_cont(ret, 0.01) OVER {frame(252)}", "ret", 252) + f" AS q1, list(ret) OVER {frame(252)} AS l FROM r)", body="SELECT symbol, trade_date, round(-q5, 6) AS var_95, round(-q1, 6) AS var_99, round(-CASE WHEN q5 IS NOT NULL THEN list_avg(list_filter(l, lambda x: x <= q5)) END, 6) AS es_95 FROM t"))
def w19(spark, d):
    return R.tail_risk(bars(spark, d))


PAIRED = "p AS (SELECT r.*, bench_ret, row_number() OVER (PARTITION BY symbol ORDER BY r.trade_date) AS k FROM r JOIN br USING (trade_date) WHERE ret IS NOT NULL AND bench_ret IS NOT NULL)"


@query("w21_rolling_beta", sql("r", "br", ctes=PAIRED + f", q AS (SELECT *, covar_samp(ret, bench_ret) OVER {frame(63)} AS cv, var_samp(bench_ret) OVER {frame(63)} AS vx, var_samp(ret) OVER {frame(63)} AS vy FROM p), s AS (SELECT *, cv / vx AS beta, sqrt(greatest(0, (vy - cv / vx * cv) * 62 / (61 * vx * 62))) AS se FROM q WHERE k >= 63 AND (k - 63) % 21 = 0)", body="SELECT symbol, trade_date, round(beta, 6) AS beta, round(beta - 1.96 * se, 6) AS lower, round(beta + 1.96 * se, 6) AS upper FROM s"))
def w21(spark, d):
    return R.rolling_beta(bars(spark, d), bench_returns(bench(spark, d)))


@query("w22_residual_reversal", sql("r", "br", ctes=PAIRED + f", q AS (SELECT *, {full(f'ret - avg(ret) OVER {frame(63)} - covar_samp(ret, bench_ret) OVER {frame(63)} / var_samp(bench_ret) OVER {frame(63)} * (bench_ret - avg(bench_ret) OVER {frame(63)})', 'ret', 63)} AS e FROM p)", body=f"SELECT symbol, trade_date, round(-({full(f'sum(e) OVER {frame(21)}', 'e', 21)}), 6) AS residual_reversal FROM q"))
def w22(spark, d):
    return R.residual_reversal(bars(spark, d), bench_returns(bench(spark, d)))


@query("w24_price_signals", sql("r", body=f"SELECT symbol, trade_date, round(lag(close, 21) OVER {W} / lag(close, 252) OVER {W} - 1, 6) AS momentum, round(-(close / lag(close, 21) OVER {W} - 1), 6) AS reversal, round(-({full(f'stddev_samp(ret) OVER {frame(63)} * sqrt(252)', 'ret', 63)}), 6) AS low_vol FROM r"))
def w24(spark, d):
    return R.price_signals(bars(spark, d))


@query("w20_rolling_sharpe", sql("r", ctes=f"p AS (SELECT *, lag(ret) OVER {W} AS pr FROM r), t AS (SELECT symbol, trade_date, {full(f'avg(ret) OVER {frame(252)} / nullif(stddev_samp(ret) OVER {frame(252)}, 0)', 'ret', 252)} * sqrt(252) AS sr, greatest(-0.9::DOUBLE, least(0.9::DOUBLE, coalesce(covar_samp(ret, pr) OVER {frame(251)} / nullif(stddev_samp(ret) OVER {frame(251)} * stddev_samp(pr) OVER {frame(251)}, 0), 0))) AS rho FROM p), e AS (SELECT *, sqrt(greatest(1e-4, 1 + 2 * rho + sr * sr / 504)) AS se FROM t WHERE sr IS NOT NULL)", body="SELECT symbol, trade_date, round(sr, 6) AS sharpe, round(rho, 6) AS rho, round(se, 6) AS se, round(sr - 1.96 * se, 6) AS lower, round(sr + 1.96 * se, 6) AS upper FROM e"))
def w20(spark, d):
    return R.rolling_sharpe(bars(spark, d))


@query("w27_triple_barrier", sql("r", ctes=f"t AS (SELECT symbol, trade_date, close, {full(f'stddev_samp(ret) OVER {frame(20)}', 'ret', 20)} AS sg, list(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nx FROM r), u AS (SELECT *, list_transform(nx, lambda c: CASE WHEN c / close - 1 >= 1.5 * sg THEN 1 WHEN c / close - 1 <= -1.5 * sg THEN -1 ELSE 0 END) AS hits FROM t WHERE len(nx) > 0 AND sg > 0), v AS (SELECT *, coalesce(list_filter(range(1, 11), lambda i: hits[i] <> 0)[1], len(nx)) AS pick FROM u)", body="SELECT symbol, trade_date, hits[pick] AS label, round(nx[pick] / close - 1, 6) AS realised FROM v"))
def w27(spark, d):
    return R.triple_barrier(bars(spark, d))


PREV = "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("w29_session_moves", sql("r", ctes=f"t AS (SELECT *, CASE WHEN count(ret) OVER {PREV} = 20 THEN (ret - avg(ret) OVER {PREV}) / stddev_samp(ret) OVER {PREV} END AS z, CASE WHEN count(volume) OVER {PREV} = 20 THEN volume / avg(volume) OVER {PREV} END AS vr FROM r)", body="SELECT symbol, trade_date, round(z, 6) AS z, round(vr, 6) AS volume_ratio, round(open / prev_close - 1, 6) AS gap, CASE WHEN z IS NULL THEN 'unknown' WHEN abs(z) >= 3 THEN 'extreme' WHEN abs(z) >= 2 THEN 'notable' WHEN abs(z) >= 1 THEN 'mild' ELSE 'normal' END AS band FROM t"))
def w29(spark, d):
    return R.session_moves(bars(spark, d))


@query("w33_move_coverage", sql("r", ctes=f"s AS (SELECT *, {full(f'stddev_samp(ret) OVER {frame(20)}', 'ret', 20)} AS sg FROM r), t AS (SELECT *, (abs(ret) <= lag(sg) OVER {W})::INT::DOUBLE AS i, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM s)", body="SELECT symbol, round(avg(i), 6) AS coverage, count(i) AS days FROM t WHERE age <= 30 GROUP BY symbol"))
def w33(spark, d):
    return R.coverage(bars(spark, d))


@query("w34_horizon_losses", sql("r", ctes="t AS (" + " UNION ALL ".join(f"SELECT symbol, {h} AS horizon, {full(f'sum(log_ret) OVER {frame(h)}', 'log_ret', h)} AS x FROM r" for h in (1, 10, 21)) + "), q AS (SELECT symbol, horizon, quantile_cont(x, 0.05) AS q, count(x) AS n FROM t GROUP BY ALL)", body="SELECT symbol, horizon, n, round(-any_value(q), 6) AS var_95, round(-avg(x), 6) AS es_95 FROM t JOIN q USING (symbol, horizon) WHERE x <= q GROUP BY symbol, horizon, n"))
def w34(spark, d):
    return R.horizon_losses(bars(spark, d))


@query("w35_trailing_variance", sql("r", body="SELECT symbol, trade_date, round(CASE WHEN count(ret) OVER w = 60 THEN avg(ret * ret) OVER w END * 1e4, 6) AS trailing_var FROM r WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"))
def w35(spark, d):
    r = with_returns(bars(spark, d))
    return R.tidy(r, "symbol", "trade_date", trailing_var=R.full(F.avg(F.col("ret") * F.col("ret")).over(R.before(60)) * 1e4, "ret", 60, R.before(60)))


@query("w37_market_context", sql("bench", ctes="t AS (SELECT *, CASE WHEN count(*) OVER w = 50 THEN close / avg(close) OVER w - 1 END AS a, close / lag(close, 20) OVER (ORDER BY trade_date) - 1 AS b FROM bench WINDOW w AS (ORDER BY trade_date ROWS 49 PRECEDING))", body="SELECT trade_date, round(a, 6) AS vs_mean_50, round(b, 6) AS change_1m FROM t"))
def w37(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy("trade_date")
    f = w.rowsBetween(-49, 0)
    return R.tidy(bench(spark, d), "trade_date", vs_mean_50=F.when(F.count("*").over(f) == 50, F.col("close") / F.avg("close").over(f) - 1), change_1m=F.col("close") / F.lag("close", 20).over(w) - 1)


@query("w38_strategy_returns", sql("r", ctes=TREND + f", h AS (SELECT symbol, trade_date, ret, coalesce(lag(state) OVER {W}, 0) AS held, coalesce(lag(state, 2) OVER {W}, 0) AS held2 FROM r JOIN t USING (symbol, trade_date))", body="SELECT symbol, trade_date, held, round(held * coalesce(ret, 0) - abs(held - held2) * 10 / 1e4, 6) AS strat_ret FROM h"))
def w38(spark, d):
    r = with_returns(bars(spark, d)).withColumn("state", R.full((F.col("close") > F.avg("close").over(R.last(50))).cast("int"), "close", 50))
    return R.tidy(R.strategy_returns(r), "symbol", "trade_date", "held", strat_ret=F.col("strat_ret"))


@query("w40_index_vol", sql("bench", ctes="t AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS x FROM bench)", body="SELECT trade_date, round(CASE WHEN count(x) OVER w = 30 THEN stddev_samp(x) OVER w * sqrt(252) END, 6) AS vol_30 FROM t WINDOW w AS (ORDER BY trade_date ROWS 29 PRECEDING)"))
def w40(spark, d):
    from pyspark.sql import Window

    f = Window.partitionBy(F.lit(1)).orderBy("trade_date").rowsBetween(-29, 0)
    return R.tidy(bench_returns(bench(spark, d)), "trade_date", vol_30=F.when(F.count("bench_ret").over(f) == 30, F.stddev_samp("bench_ret").over(f) * 252**0.5))
