"""Registered queries: rows as they are published, put together from other queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import rolling as R
from panelspark.plans import chains, cross_sections, events, feeds, panels, risk, snapshots, states
from panelspark.registry import SQL, query
from panelspark.sources.views import bars, sectors, sql


def of(name: str) -> str:
    return f"({SQL[name]})"


@query("sn1_radar_snapshot", f"SELECT 'drift' AS section, count(*) AS rows, CASE WHEN count(*) = count(place) THEN 'valid' ELSE 'broken' END AS validation FROM {of('r17_f23_drift_screen')} UNION ALL SELECT 'value', count(*), CASE WHEN count(*) = count(score) THEN 'valid' ELSE 'broken' END FROM {of('r16_value_screen')} UNION ALL SELECT 'squeeze', count(*), CASE WHEN count(*) = count(score) THEN 'valid' ELSE 'broken' END FROM {of('r18_short_squeeze')} UNION ALL SELECT 'excluded: ' || reason, n, 'valid' FROM {of('a14_exclusion_ledger')}")
def sn1(spark, d):
    """The radar's sections, each with its rows and whether they keep the contract, and the
    ledger of what was excluded."""
    def section(name: str, df: DataFrame, need: str) -> DataFrame:
        return df.agg(F.lit(name).alias("section"), F.count("*").alias("rows"), F.when(F.count("*") == F.count(need), "valid").otherwise("broken").alias("validation"))

    parts = [section("drift", events.r17(spark, d), "place"), section("value", cross_sections.r16(spark, d), "score"), section("squeeze", feeds.r18_short(spark, d), "score")]
    ledger = cross_sections.a14(spark, d).select(F.concat(F.lit("excluded: "), "reason").alias("section"), F.col("n").alias("rows"), F.lit("valid").alias("validation"))
    return reduce(DataFrame.unionByName, [*parts, ledger])


@query("sn5_dashboard", sql("sectors", body=f"SELECT s.symbol, sector, trade_date, b.ret, z, earnings_state, CASE WHEN print_date IS NULL THEN 'no print' WHEN surprise > 0 THEN 'beat' WHEN surprise < 0 THEN 'miss' ELSE 'in line' END AS note, place, CASE WHEN b.symbol IS NULL THEN 'pending' ELSE 'ready' END AS state FROM sectors s LEFT JOIN {of('sn3_daily_brief')} b USING (symbol) LEFT JOIN (SELECT symbol, place FROM {of('r13_notable_ranking')}) k USING (symbol)"))
def sn5(spark, d):
    """Each covered symbol's latest brief, its place by the size of the move, a note on the
    last print; symbols without a brief are pending."""
    b = states.sn3(spark, d).withColumn("there", F.lit(True))
    t = sectors(spark, d).select("symbol", "sector").join(b, "symbol", "left").join(states.r13(spark, d).select("symbol", "place"), "symbol", "left")
    note = F.when(F.col("print_date").isNull(), "no print").when(F.col("surprise") > 0, "beat").when(F.col("surprise") < 0, "miss").otherwise("in line")
    return t.select("symbol", "sector", "trade_date", "ret", "z", "earnings_state", note.alias("note"), "place", F.when(F.col("there"), "ready").otherwise("pending").alias("state"))


NEW = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1"


@query("sn6_risk_row", f"SELECT symbol, a.n, mean, sd, skew, kurt, drawdown, sharpe, se, var_95, var_99, es_95, beta, alpha, light, deflated, w.metric_vol FROM {of('a35_return_moments')} a LEFT JOIN (SELECT symbol, drawdown FROM {of('w5_drawdown')} {NEW}) USING (symbol) LEFT JOIN (SELECT symbol, sharpe, se FROM {of('w20_rolling_sharpe')} {NEW}) USING (symbol) LEFT JOIN (SELECT symbol, var_95, var_99, es_95 FROM {of('w19_tail_risk')} {NEW}) USING (symbol) LEFT JOIN (SELECT symbol, beta, alpha FROM {of('st3_ols_beta')}) USING (symbol) LEFT JOIN (SELECT symbol, light FROM {of('st11_st12_var_backtest')}) USING (symbol) LEFT JOIN (SELECT symbol, deflated FROM {of('st7_deflated_sharpe')}) USING (symbol) LEFT JOIN (SELECT symbol, vol_252d AS metric_vol FROM {of('a33_metric_vector')}) w USING (symbol)")
def sn6(spark, d):
    """One wide row a symbol: moments, drawdown, rolling Sharpe, tail, beta, backtest light."""
    newest = lambda f, *cols: R.latest(f(spark, d), 1).select("symbol", *cols)
    parts = [
        newest(panels.w5, "drawdown"), newest(panels.w20, "sharpe", "se"), R.tail_risk(bars(spark, d), newest=True).select("symbol", "var_95", "var_99", "es_95"), risk.st3(spark, d).select("symbol", "beta", "alpha"), risk.st12(spark, d).select("symbol", "light"),
        risk.st7(spark, d).select("symbol", "deflated"), cross_sections.a33(spark, d).select("symbol", F.col("vol_252d").alias("metric_vol")),
    ]
    return reduce(lambda a, b: a.join(b, "symbol", "left"), parts, cross_sections.a35(spark, d))


@query("sn7_option_posture", f"WITH e AS (SELECT underlying, dte FROM {of('j17_nearest_expiry')}), m AS (SELECT underlying, dte, expected_move, straddle FROM {of('f6_f7_expected_moves')}), {snapshots.BRANDS} SELECT e.underlying, e.dte, expected_move, straddle, oi_ratio, volume_ratio, max_pain, symbol, vrp, iv_rank, CASE WHEN expected_move IS NULL THEN 'insufficient volatility' WHEN symbol IS NULL OR vrp IS NULL THEN 'insufficient history' WHEN iv_rank > 50 THEN 'sell premium: high rank' WHEN vrp > 0 THEN 'sell premium: rich' ELSE 'buy premium' END AS verdict FROM e LEFT JOIN m USING (underlying, dte) LEFT JOIN (SELECT underlying, oi_ratio, volume_ratio FROM {of('a8_a47_put_call')} WHERE total = 1) USING (underlying) LEFT JOIN (SELECT underlying, max_pain FROM {of('a9_j19_max_pain')}) USING (underlying) LEFT JOIN ml USING (underlying) LEFT JOIN (SELECT symbol, vrp FROM {of('f19_variance_premium')}) USING (symbol) LEFT JOIN (SELECT symbol, iv_rank FROM {of('a38_iv_rank')}) USING (symbol)")
def sn7(spark, d):
    """Posture of each chain at the expiry nearest to a month: expected move, put-call ratios,
    pain, the symbol's premium and rank, and a rule's verdict on premium."""
    t = chains.j17(spark, d).join(chains.f6(spark, d).select("underlying", "dte", "expected_move", "straddle"), ["underlying", "dte"], "left")
    t = t.join(chains.a8(spark, d).where("total = 1").select("underlying", "oi_ratio", "volume_ratio"), "underlying", "left").join(chains.a9(spark, d).select("underlying", "max_pain"), "underlying", "left")
    t = t.join(snapshots.listed(spark, d), "underlying", "left").join(snapshots.f19(spark, d).select("symbol", "vrp"), "symbol", "left").join(snapshots.a38(spark, d).select("symbol", "iv_rank"), "symbol", "left")
    verdict = F.when(F.col("expected_move").isNull(), "insufficient volatility").when(F.col("symbol").isNull() | F.col("vrp").isNull(), "insufficient history").when(F.col("iv_rank") > 50, "sell premium: high rank").when(F.col("vrp") > 0, "sell premium: rich").otherwise("buy premium")
    return t.withColumn("verdict", verdict)


@query("sn8_institutional_row", f"SELECT symbol, c.spread AS high_low_spread, l.spread AS roll_spread, amihud_252, pct_float, score AS squeeze, beta_up, beta_down, up_capture, down_capture FROM {of('a31_corwin_schultz')} c LEFT JOIN {of('a32_roll_spread')} l USING (symbol) LEFT JOIN (SELECT symbol, amihud_252 FROM {of('a29_a30_liquidity')}) USING (symbol) LEFT JOIN (SELECT symbol, pct_float, score FROM {of('r18_short_squeeze')}) USING (symbol) LEFT JOIN (SELECT symbol, beta_up, beta_down FROM {of('st4_regime_betas')}) USING (symbol) LEFT JOIN (SELECT symbol, up_capture, down_capture FROM {of('a22_capture_ratios')}) USING (symbol)")
def sn8(spark, d):
    """Spreads, illiquidity, squeeze, betas by the market's sign, capture."""
    X = cross_sections
    parts = [
        X.a32(spark, d).select("symbol", F.col("spread").alias("roll_spread")), X.a29(spark, d).select("symbol", "amihud_252"), feeds.r18_short(spark, d).select("symbol", "pct_float", F.col("score").alias("squeeze")),
        risk.st4(spark, d).select("symbol", "beta_up", "beta_down"), X.a22(spark, d).select("symbol", "up_capture", "down_capture"),
    ]
    return reduce(lambda a, b: a.join(b, "symbol", "left"), parts, X.a31(spark, d).select("symbol", F.col("spread").alias("high_low_spread")))


@query("sn9_positioning_row", f"SELECT company, state, multiple, pct_mean, cheapness, band, upside_pct, pe, peers FROM {of('pf12_not_meaningful')} LEFT JOIN (SELECT company, pct_mean FROM {of('r2_percentile_ranks')}) USING (company) LEFT JOIN (SELECT company, cheapness, band FROM {of('r15_peer_table')}) USING (company) LEFT JOIN (SELECT company, upside_pct FROM {of('f22_target_upside')}) USING (company) LEFT JOIN (SELECT company, value AS pe FROM {of('src16_first_of_keys')} WHERE label = 'pe') USING (company) LEFT JOIN (SELECT company, count(*) AS peers FROM {of('j20_peers')} GROUP BY company) USING (company)")
def sn9(spark, d):
    """Valuation of each company: state, percentile, cheapness among peers, upside, peers."""
    from panelspark.plans import joins

    X = cross_sections
    parts = [
        X.r2(spark, d).select("company", "pct_mean"), X.r15(spark, d).select("company", "cheapness", "band"), feeds.f22(spark, d).select("company", "upside_pct"),
        feeds.src16(spark, d).where("label = 'pe'").select("company", F.col("value").alias("pe")), joins.j20(spark, d).groupBy("company").agg(F.count("*").alias("peers")),
    ]
    return reduce(lambda a, b: a.join(b, "company", "left"), parts, X.pf12(spark, d))


@query("sn4_heatmap_tiles", sql("r", "sectors", body="SELECT symbol, sector, round(close / lag(close, 1) OVER (PARTITION BY symbol ORDER BY trade_date) - 1, 6) AS day, round(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) - 1, 6) AS week, round(close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY trade_date) - 1, 6) AS month, round(close * volume, 2) AS size FROM r JOIN sectors USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1"))
def sn4_tiles(spark, d):
    """A tile a symbol: its sector, change over a day, a week and a month, and its weight."""

    w = Window.partitionBy("symbol").orderBy("trade_date")
    change = lambda n: F.round(F.col("close") / F.lag("close", n).over(w) - 1, 6)
    b = bars(spark, d).withColumns({"day": change(1), "week": change(5), "month": change(21), "size": F.round(F.col("close") * F.col("volume"), 2)})
    return R.latest(b, 1).join(sectors(spark, d).select("symbol", "sector"), "symbol").select("symbol", "sector", "day", "week", "month", "size")
