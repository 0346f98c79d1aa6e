"""Registered queries: signal job and gates, features, stacked panels, strategies."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf
from panelspark.operators import cross as C
from panelspark.operators import ranks
from panelspark.operators import rolling as R
from panelspark.operators import signals as G
from panelspark.operators import studies as S
from panelspark.operators.asof import asof
from panelspark.operators.features import FEATURES
from panelspark.operators.features import features as features_of
from panelspark.plans.cross_sections import BUCKETS, PANEL, PERF, PERF_BODY, WEIGHTS
from panelspark.plans.events import EARN, METRICS, event_metrics
from panelspark.plans.panels import PAIRED, REC, W, frame, full
from panelspark.plans.risk import ROTATE, bt1, expected_maximum, unbiased
from panelspark.registry import query
from panelspark.sources.views import bars, bench, bench_returns, by_symbol, ohlcv, priced, sectors, sql, with_returns

SIGNALS = ("momentum", "reversal", "low_vol")
STACKED = f"sg AS (SELECT symbol, trade_date, round(lag(close, 21) OVER {W} / lag(close, 252) OVER {W} - 1, 6) AS momentum, round(-(close / lag(close, 21) OVER {W} - 1), 6) AS reversal, round(-({full(f'stddev_samp(ret) OVER {frame(63)} * sqrt(252)', 'ret', 63)}), 6) AS low_vol FROM r), pn AS (" + " UNION ALL ".join(f"SELECT '{k}' AS signal, symbol, trade_date, {k} AS value FROM sg WHERE {k} IS NOT NULL" for k in SIGNALS) + ")"


def stacked(spark, d):
    """(signal, symbol, trade_date, value): the price signals' panels, one under another."""
    return R.price_signals(bars(spark, d)).unpivot(["symbol", "trade_date"], list(SIGNALS), "signal", "value").where("value IS NOT NULL")


@query("u4_stacked_panels", sql("r", ctes=STACKED, body="SELECT * FROM pn"))
def u4(spark, d):
    return stacked(spark, d)


@query("a48_rejected_panels", sql("bars", ctes="g AS (SELECT symbol, count(*) AS n, max(trade_date) AS last FROM bars GROUP BY symbol), t AS (SELECT max(trade_date) AS t FROM bars)", body="SELECT symbol, n, CASE WHEN n < 530 THEN 'insufficient history (< 530 bars)' WHEN last < t - 10 THEN 'stale' END AS reason FROM g, t WHERE n < 530 OR last < t - 10"))
def a48(spark, d):
    """Panels too thin or too old to be used, each with its reason."""
    b = bars(spark, d)
    g = b.groupBy("symbol").agg(F.count("*").alias("n"), F.max("trade_date").alias("last")).withColumn("t", b.agg(F.max("trade_date")).scalar())
    reason = F.when(F.col("n") < 530, "insufficient history (< 530 bars)").when(F.datediff("t", "last") > 10, "stale")
    return g.select("symbol", "n", reason.alias("reason")).where("reason IS NOT NULL")


NET = PANEL + ", " + BUCKETS + ", " + WEIGHTS + ", ch AS (SELECT coalesce(a.k, b.k + 1) AS k, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS turnover FROM ww a FULL JOIN ww b ON a.symbol = b.symbol AND a.k = b.k + 1 GROUP BY 1), sp AS (SELECT trade_date, avg(f1) FILTER (bucket = 10) - avg(f1) FILTER (bucket = 1) AS spread FROM b2 WHERE n >= 20 GROUP BY trade_date), nt AS (SELECT spread, turnover, spread - turnover * 2 * 10 / 1e4 AS net FROM ch JOIN dd USING (k) JOIN sp USING (trade_date) WHERE spread IS NOT NULL)"


@query("r9_net_performance", sql("bars", ctes=NET, body="SELECT count(*) AS dates, round(avg(turnover), 6) AS mean_turnover, round(avg(spread) * 252, 6) AS gross_year, round(avg(net) * 252, 6) AS net_year, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 6) AS net_sharpe FROM nt"))
def r9_net(spark, d):
    """Spread of the reversal deciles after the cost of their turnover."""
    from panelspark.plans.cross_sections import r9

    b = C.buckets(_panel(spark, d), "sig", 10).where("n >= 20")
    mean = lambda k: F.avg(F.when(F.col("bucket") == k, F.col("f1")))
    spread = b.groupBy("trade_date").agg((mean(10) - mean(1)).alias("spread")).where("spread IS NOT NULL")
    n = spread.join(r9(spark, d), "trade_date").withColumn("net", F.col("spread") - F.col("turnover") * 2 * 10 / 1e4)
    return n.agg(F.count("*").alias("dates"), F.round(F.avg("turnover"), 6).alias("mean_turnover"), F.round(F.avg("spread") * 252, 6).alias("gross_year"), F.round(F.avg("net") * 252, 6).alias("net_year"), F.round(F.try_divide(F.avg("net"), F.stddev_samp("net")) * R.YEAR, 6).alias("net_sharpe"))


def _panel(spark, d):
    from panelspark.plans.cross_sections import panel

    return panel(spark, d)


@query("r8_monotonicity", sql("bars", ctes=PANEL + ", " + BUCKETS + ", m AS (SELECT bucket, avg(f1) AS m FROM b2 WHERE n >= 20 GROUP BY bucket), k AS (SELECT bucket, m, lag(m) OVER (ORDER BY bucket) AS p, rank() OVER (ORDER BY m) AS k FROM m)", body="SELECT count(*) AS buckets, coalesce(bool_and(m > p), false) AS strictly_monotonic, round(covar_pop(bucket, k) / nullif(stddev_pop(bucket) * stddev_pop(k), 0), 6) AS spearman FROM k"))
def r8_mono(spark, d):
    """Whether the deciles' mean returns rise throughout, and how far they do by rank."""
    m = C.buckets(_panel(spark, d), "sig", 10).where("n >= 20").groupBy("bucket").agg(F.avg("f1").alias("m"))
    w = Window.partitionBy(F.lit(1))  # ten rows
    k = m.withColumns({"p": F.lag("m").over(w.orderBy("bucket")), "k": F.rank().over(w.orderBy("m"))})
    return k.agg(F.count("*").alias("buckets"), F.coalesce(F.bool_and(F.col("m") > F.col("p")), F.lit(False)).alias("strictly_monotonic"), F.round(F.try_divide(F.covar_pop("bucket", "k"), F.stddev_pop("bucket") * F.stddev_pop("k")), 6).alias("spearman"))


TRIALS = 12


def lab_panel(spark, d):
    """The price signals and the residual reversal, a column each, with returns ahead."""
    return R.signal_panel(bars(spark, d), bench_returns(bench(spark, d)))


def deflated(n, sr, skew, kurt):
    skew, kurt = unbiased(n, skew, kurt)
    z = sr / F.sqrt(F.greatest(F.lit(1e-12), (1 - skew * sr + (kurt + 2) / 4 * sr * sr) / (n - 1)))
    return cdf(z - expected_maximum(TRIALS))


@query("st15_signal_job")
def st15(spark, d):
    """All signals of the panel in one job: correlations by horizon, deciles, costs, gates."""
    out = G.evaluate(lab_panel(spark, d), {"1d": "fwd_1", "5d": "fwd_5", "21d": "fwd_21"}, deflated, R.SIGNALS)
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


@query("r14_gated_ranks")
def r14(spark, d):
    """Each symbol's place in the newest cross-section of each signal; only validated signals
    show it."""
    newest = lab_panel(spark, d).groupBy("symbol").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("trade_date"))).alias(k) for k in R.SIGNALS])
    newest = newest.unpivot("symbol", list(R.SIGNALS), "signal", "value").where("value IS NOT NULL")
    w = Window.partitionBy("signal")
    newest = newest.withColumns({"place": F.rank().over(w.orderBy(F.desc("value"))), "pct": C.percentile_rank(newest, "value", ["signal"], "mean", 2)})
    s = newest.join(st15(spark, d).select("signal", "status"), "signal")
    ok = lambda c: F.when(F.col("status") == "validated", F.col(c))
    return s.select("signal", "symbol", "status", ok("place").alias("place"), F.round(ok("pct"), 1).alias("percentile"), ok("value").alias("value"))


@query("u5_first_fold", sql("r", ctes="f AS (SELECT symbol, trade_date, ret, fold FROM r, range(40) t(fold) WHERE rn > fold * 21 AND rn <= fold * 21 + 63)", body="SELECT symbol, trade_date, fold::INT AS fold, round(ret, 6) AS ret FROM f QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY fold) = 1"))
def u5(spark, d):
    """Folds of 63 sessions, 21 apart, overlap; of the rows of a date the first fold's stays."""
    r = with_returns(bars(spark, d))
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - 63) / 21)).cast("int")
    last = F.floor((F.col("rn") - 1) / 21).cast("int")
    f = r.select("symbol", "trade_date", "ret", F.explode(F.sequence(first, last)).alias("fold")).where("fold < 40")
    k = F.row_number().over(Window.partitionBy("symbol", "trade_date").orderBy("fold"))
    return f.withColumn("k", k).where("k = 1").select("symbol", "trade_date", "fold", F.round("ret", 6).alias("ret"))


COSTED = ROTATE + ", rc AS (SELECT rb.*, mo > 0 AS up FROM rb JOIN (SELECT symbol, trade_date AS rd, mo FROM m) USING (symbol, rd)), rv AS (SELECT 'relative' AS variant, symbol, b FROM rc UNION ALL SELECT 'absolute', symbol, b FROM rc WHERE up), tv AS (SELECT coalesce(x.variant, y.variant) AS variant, coalesce(x.b, y.b + 1) AS b, count(*) FILTER (x.symbol IS NULL OR y.symbol IS NULL) * 0.2 / 2 AS turnover FROM rv x FULL JOIN rv y ON x.variant = y.variant AND x.symbol = y.symbol AND x.b = y.b + 1 GROUP BY 1, 2), fb AS (SELECT min(b) AS b0 FROM rv), hd AS (SELECT variant, m.trade_date, k, rv.b, sum(ret) / 5 AS gross FROM m JOIN ds USING (trade_date) JOIN rv ON rv.symbol = m.symbol AND rv.b = (k - 1) // 21 WHERE ret IS NOT NULL GROUP BY ALL), fd AS (SELECT variant, b, min(k) AS k FROM hd GROUP BY ALL)"


@query("bt1_rotation_with_costs", sql("r", "bench", ctes=COSTED, body="SELECT hd.variant, trade_date, round(gross, 6) AS gross, round(CASE WHEN fd.k IS NOT NULL AND hd.b > b0 THEN turnover * 7.5 / 1e4 ELSE 0 END, 8) AS cost, round(gross - CASE WHEN fd.k IS NOT NULL AND hd.b > b0 THEN turnover * 7.5 / 1e4 ELSE 0 END, 6) AS net FROM hd JOIN tv USING (variant, b) LEFT JOIN fd ON fd.variant = hd.variant AND fd.b = hd.b AND fd.k = hd.k, fb"))
def bt1_costs(spark, d):
    """The rotation by itself and with an absolute hurdle (a name whose own momentum isn't
    positive is left in cash); half the change of weights costs 7.5 basis points on the
    first day of each holding period but the first."""
    r, w = with_returns(bars(spark, d)), by_symbol()
    m = r.withColumn("mo", F.lag("close", 21).over(w) / F.lag("close", 126).over(w) - 1)
    ds = bench(spark, d).select("trade_date", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")).alias("k"))
    m = m.join(ds, "trade_date")
    top = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc(F.round("mo", 9)), "symbol"))
    rb = m.where("k % 21 = 0 AND mo IS NOT NULL").withColumn("p", top).where("p <= 5").select("symbol", F.expr("k div 21").alias("b"), (F.col("mo") > 0).alias("up"))
    rv = rb.select(F.lit("relative").alias("variant"), "symbol", "b").unionByName(rb.where("up").select(F.lit("absolute").alias("variant"), "symbol", "b"))
    prev = rv.select("variant", "symbol", (F.col("b") + 1).alias("b"), F.lit(1).alias("old"))
    tv = rv.withColumn("new", F.lit(1)).join(prev, ["variant", "symbol", "b"], "full").groupBy("variant", "b").agg((F.count_if(F.col("new").isNull() | F.col("old").isNull()) * 0.2 / 2).alias("turnover"))
    held = m.where("ret IS NOT NULL").withColumn("b", F.expr("(k - 1) div 21")).join(rv, ["symbol", "b"]).groupBy("variant", "trade_date", "k", "b").agg((F.sum("ret") / 5).alias("gross"))
    held = held.withColumn("first", F.min("k").over(Window.partitionBy("variant", "b"))).join(tv, ["variant", "b"]).withColumn("b0", rv.agg(F.min("b")).scalar())
    cost = F.when((F.col("k") == F.col("first")) & (F.col("b") > F.col("b0")), F.col("turnover") * 7.5 / 1e4).otherwise(0.0)
    return held.select("variant", "trade_date", F.round("gross", 6).alias("gross"), F.round(cost, 8).alias("cost"), F.round(F.col("gross") - cost, 6).alias("net"))


CUT = "ro AS (SELECT 'strategy' AS symbol, m.trade_date, round(sum(ret) / 5, 6) AS x FROM m JOIN ds USING (trade_date) JOIN rb ON rb.symbol = m.symbol AND rb.b = (k - 1) // 21 WHERE ret IS NOT NULL GROUP BY m.trade_date), bo AS (SELECT * FROM ro UNION ALL SELECT 'benchmark', trade_date, bench_ret FROM br WHERE trade_date IN (SELECT trade_date FROM ro)), c AS (SELECT * FROM bo WHERE trade_date >= (SELECT (max(trade_date) - INTERVAL 36 MONTH)::DATE FROM bo) AND x > -1), t AS (SELECT *, exp(sum(ln(1 + x)) OVER (PARTITION BY symbol ORDER BY trade_date)) AS wealth FROM c), " + PERF.format(x="x")


@query("bt6_universe_vs_benchmark", sql("r", "bench", "br", ctes=ROTATE + ", " + CUT, body=PERF_BODY.replace("SELECT symbol,", "SELECT symbol AS series,")))
def bt6(spark, d):
    """The rotation against the benchmark over the last three years, on the same dates."""
    s = bt1(spark, d).select(F.lit("strategy").alias("series"), "trade_date", F.col("ret").alias("x"))
    b = bench_returns(bench(spark, d)).join(s.select("trade_date"), "trade_date", "left_semi").select(F.lit("benchmark").alias("series"), "trade_date", F.col("bench_ret").alias("x"))
    both = s.unionByName(b)
    both = both.where(F.col("trade_date") >= F.add_months(both.agg(F.max("trade_date")).scalar(), -36))
    return C.perf_stats(both, ["series"], "x", "trade_date")


INDEX = "sx AS (SELECT sector, trade_date, sum(cents) / sum(q) / 100 AS close FROM (SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, l_shipdate::DATE AS trade_date, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity AS q FROM lineitem) JOIN sectors USING (symbol) GROUP BY ALL), sy AS (SELECT sector, trade_date, lead(close, 20) OVER (PARTITION BY sector ORDER BY trade_date) / close - 1 AS sector_20 FROM sx)"


def sector_index(spark, d):
    """(sector, trade_date, close): each sector's pooled bars, its fund as it were."""
    return ohlcv(priced(spark, d).join(sectors(spark, d).select("symbol", "sector"), "symbol"), "sector", "trade_date").select("sector", "trade_date", "close")


@query("j12_sector_return", sql("r", "sectors", ctes=EARN + ", " + METRICS + ", em AS (SELECT e.symbol, e.date, trade_date, round(drift_20, 6) AS drift_20 FROM (SELECT * FROM earn2 WHERE NOT upcoming) e ASOF JOIN mx ON e.symbol = mx.symbol AND e.date <= trade_date), " + INDEX + ", es AS (SELECT em.*, sector FROM em JOIN sectors USING (symbol))", body="SELECT es.symbol, es.date, es.sector, drift_20, round(sector_20, 6) AS sector_20, round(drift_20 - round(sector_20, 6), 6) AS relative_20 FROM es ASOF JOIN sy ON es.sector = sy.sector AND es.trade_date <= sy.trade_date"))
def j12(spark, d):
    """The drift after each print beside that of the sector's index over as many sessions."""
    x = sector_index(spark, d)
    x = x.withColumn("sector_20", F.lead("close", 20).over(Window.partitionBy("sector").orderBy("trade_date")) / F.col("close") - 1).withColumnRenamed("trade_date", "t")
    e = event_metrics(spark, d).where("trade_date IS NOT NULL").select("symbol", "date", "trade_date", "drift_20").join(sectors(spark, d).select("symbol", "sector"), "symbol")
    e = asof(e, "trade_date", x, "t", ["sector"], ["t", "sector_20"], forward=True).where("t IS NOT NULL")
    s = F.round("sector_20", 6)
    return e.select("symbol", "date", "sector", "drift_20", s.alias("sector_20"), F.round(F.col("drift_20") - s, 6).alias("relative_20"))


@query("es5_earnings_events")
def es5(spark, d):
    """The last eight prints of each symbol: abnormal return over the three sessions around,
    its drift leg, its place among all, and the session metrics."""
    m = event_metrics(spark, d)
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    m = m.withColumn("k", k).where("k <= 8").drop("k")
    e = m.select("symbol", F.lit("EARNINGS").alias("event_type"), F.col("date").alias("event_date"), F.lit(False).alias("after_close"))
    s = S.event_study(e, S.paired_sessions(bars(spark, d), bench_returns(bench(spark, d))), window=(-1, 1)).select("symbol", F.col("event_date").alias("date"), "car", "t", "p", F.col("drift").alias("drift_car"))
    out = m.join(s, ["symbol", "date"], "left").persist(StorageLevel.DISK_ONLY)  # eight rows a symbol, read for bounds, places and rows
    place = ranks.positions(out, "car").select(F.col("car").alias("__car"), (F.col("below") + F.col("same")).alias("__at"))
    n = out.agg(F.count("car")).scalar()
    out = out.join(place, F.col("car") == F.col("__car"), "left").drop("__car")
    pool = F.round(100 * F.col("__at") / n, 6)
    return out.select("*", (F.coalesce(F.col("p") < 0.05, F.lit(False))).alias("significant"), pool.alias("pool_pct")).drop("__at")


def _features_sql() -> str:
    sma = lambda n, of="close": full(f"avg({of}) OVER {frame(n)}", of, n)
    sd = lambda n, of: full(f"stddev_samp({of}) OVER {frame(n)}", of, n)
    chg = lambda n: f"close / lag(close, {n}) OVER {W} - 1"
    cols = {
        "ret_1": "ret", **{f"ret_{n}": chg(n) for n in (5, 10, 20)}, "vol_10": sd(10, "ret"), "vol_20": sd(20, "ret"), "rsi_14": "rsi_14_plain", "macd_hist": "macd_hist / close", "atr_14": "atr_14 / close", "hl_range": "hl",
        **{f"dist_sma{n}": f"close / {sma(n)} - 1" for n in (20, 50, 200)}, "vol_z": f"(volume - {sma(20, 'volume')}) / ({sd(20, 'volume')} + 1e-8::DOUBLE)", "mom_63": chg(63), **{f"gk_vol_{n}": full(f"sqrt(greatest(0, avg(gk) OVER {frame(n)}))", "gk", n) for n in (10, 20)},
        "bb_width": f"4 * {sd(20, 'close')} / ({sma(20)} + 1e-8::DOUBLE)", "bb_pct": f"(close - ({sma(20)} - 2 * {sd(20, 'close')})) / (4 * {sd(20, 'close')} + 1e-8::DOUBLE)", "vol_trend_5_20": f"{sma(5, 'volume')} / ({sma(20, 'volume')} + 1e-8::DOUBLE)",
        "dist_ema8": "close / ema_8 - 1", "dist_ema21": "close / ema_21 - 1", "ema_cross_8_21": "ema_8 / ema_21 - 1", "hl_range_std_10": sd(10, "hl"),
    }
    return REC + ", f0 AS (SELECT r.*, rs.* EXCLUDE (symbol, rn), (high - low) / close AS hl, 0.5 * pow(ln(high / low + 1e-8::DOUBLE), 2) - 0.3862943611198906::DOUBLE * pow(ln(close / open + 1e-8::DOUBLE), 2) AS gk FROM r JOIN rs USING (symbol, rn)), ft AS (SELECT symbol, trade_date, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in cols.items()) + " FROM f0)"


FEATURES_SQL = _features_sql()


def features(spark, d, complete: bool = False, labelled: bool = False):
    """(symbol, trade_date, 24 features): each uses rows up to its day; ``complete`` ones only
    if asked for. ``labelled``: of symbols with 260 bars, with the triple-barrier label and
    return, rows that have them; all from the symbols' one shuffle and one pass."""
    r = with_returns(bars(spark, d))
    if labelled:
        r = r.withColumn("len", F.count("*").over(Window.partitionBy("symbol"))).where("len >= 260")
    sq = lambda c: c * c
    r = r.withColumns({"hl": (F.col("high") - F.col("low")) / F.col("close"), "gk": 0.5 * sq(F.ln(F.col("high") / F.col("low") + 1e-8)) - 0.3862943611198906 * sq(F.ln(F.col("close") / F.col("open") + 1e-8))})
    return features_of(r, complete, labelled)


@query("w26_features", sql("r", ctes=FEATURES_SQL, body="SELECT * FROM ft", recursive=True))
def w26(spark, d):
    return features(spark, d)


F18_SQL = FEATURES_SQL + ", fl AS (SELECT * FROM ft QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1), sv AS (SELECT symbol, 100 * stddev_samp(ret) * sqrt(252) AS av, 100 * quantile_cont(ret, 0.05) AS v95 FROM r GROUP BY symbol), sc AS (SELECT symbol, greatest(-1, least(1, ((dist_sma20 > 0)::INT + (dist_sma50 > 0)::INT + (dist_sma200 > 0)::INT - 1.5) / 1.5 + CASE WHEN ema_cross_8_21 > 0 THEN 0.1 ELSE -0.1 END)) AS trend, greatest(-1, least(1, (rsi_14 - 50) / 40 * 0.4 + greatest(-1, least(1, mom_63 / 0.3)) * 0.4 + CASE WHEN macd_hist > 0 THEN 0.2 ELSE -0.2 END)) AS momentum, CASE WHEN av < 15 THEN 0.2 WHEN av < 25 THEN 0.05 WHEN av < 40 THEN -0.15 ELSE -0.35 END AS volatility, greatest(-0.4, least(0, -(abs(v95) - 2) / 6)) AS tail_risk FROM fl JOIN sv USING (symbol) WHERE rsi_14 IS NOT NULL AND dist_sma200 IS NOT NULL AND mom_63 IS NOT NULL)"


@query("f18_factor_scores", sql("r", ctes=F18_SQL, recursive=True, body="SELECT symbol, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in ("trend", "momentum", "volatility", "tail_risk")) + ", CASE WHEN round(trend::DOUBLE, 6) > 0.2 THEN 'up-trend' WHEN round(trend::DOUBLE, 6) < -0.2 THEN 'down-trend' ELSE 'mixed' END AS reading FROM sc"))
def f18(spark, d):
    """Scores of each symbol's latest features, -1 to 1: trend by reclaimed means and the
    cross, momentum by RSI, change and MACD, volatility regime, tail risk (never positive)."""
    f = R.latest(features(spark, d), 1).where("rsi_14 IS NOT NULL AND dist_sma200 IS NOT NULL AND mom_63 IS NOT NULL")
    s = with_returns(bars(spark, d)).groupBy("symbol").agg((100 * F.stddev_samp("ret") * R.YEAR).alias("av"), (100 * F.percentile("ret", 0.05)).alias("v95"))
    above = sum((F.col(c) > 0).cast("int") for c in ("dist_sma20", "dist_sma50", "dist_sma200"))
    side = lambda c, x: F.when(F.col(c) > 0, x).otherwise(-x)
    out = f.join(s, "symbol").select(
        "symbol", F.round(R.clip((above - 1.5) / 1.5 + side("ema_cross_8_21", 0.1), -1, 1), 6).alias("trend"), F.round(R.clip((F.col("rsi_14") - 50) / 40 * 0.4 + R.clip(F.col("mom_63") / 0.3, -1, 1) * 0.4 + side("macd_hist", 0.2), -1, 1), 6).alias("momentum"),
        F.when(F.col("av") < 15, 0.2).when(F.col("av") < 25, 0.05).when(F.col("av") < 40, -0.15).otherwise(-0.35).alias("volatility"), F.round(R.clip(-(F.abs("v95") - 2) / 6, -0.4, 0), 6).alias("tail_risk"),
    )
    return out.withColumn("reading", F.when(F.col("trend") > 0.2, "up-trend").when(F.col("trend") < -0.2, "down-trend").otherwise("mixed"))


LABELS = f"lb0 AS (SELECT symbol, trade_date, close, count(*) OVER (PARTITION BY symbol) AS len, {full(f'stddev_samp(ret) OVER {frame(20)}', 'ret', 20)} AS sg, list(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nx FROM r), lb1 AS (SELECT *, list_transform(nx, lambda c: CASE WHEN c / close - 1 >= 1.5 * sg THEN 1 WHEN c / close - 1 <= -1.5 * sg THEN -1 ELSE 0 END) AS hits FROM lb0 WHERE len(nx) > 0 AND sg > 0 AND len >= 260), lb AS (SELECT symbol, trade_date, hits[coalesce(list_filter(range(1, 11), lambda i: hits[i] <> 0)[1], len(nx))] AS label, round(nx[coalesce(list_filter(range(1, 11), lambda i: hits[i] <> 0)[1], len(nx))] / close - 1, 6) AS realised FROM lb1)"


@query("ml1_labelled_features", sql("r", ctes=FEATURES_SQL + ", " + LABELS, body="SELECT symbol, trade_date, " + ", ".join(FEATURES) + ", label, realised FROM ft JOIN lb USING (symbol, trade_date) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES), recursive=True))
def ml1(spark, d):
    """Features with the triple-barrier label and return; whole rows of symbols with 260 bars."""
    return features(spark, d, True, labelled=True)


@query("st6_newey_west_t", sql("r", ctes="u0 AS (SELECT symbol, ret, row_number() OVER w AS k, count(*) OVER s AS n, ret - avg(ret) OVER s AS u, avg(ret) OVER s AS m FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), s AS (PARTITION BY symbol)), u1 AS (SELECT *, least(floor(4 * pow(n / 100, 2 / 9)), n - 1) AS lags FROM u0), v AS (SELECT a.symbol, any_value(a.n) AS n, any_value(a.m) AS m, sum(a.u * b.u * CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / (a.lags + 1)) END) AS v FROM u1 a JOIN u1 b ON a.symbol = b.symbol AND b.k BETWEEN a.k - a.lags AND a.k GROUP BY a.symbol)", body="SELECT symbol, n, round(m, 6) AS mean, round(sqrt(greatest(0, v)) / n, 6) AS se, round(m / nullif(sqrt(greatest(0, v)) / n, 0), 6) AS t FROM v"))
def st6(spark, d):
    return C.newey_west(with_returns(bars(spark, d)), "ret", ["symbol"], "trade_date")


@query("w20_probabilistic_sharpe", sql("r", ctes="a AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM r), g AS (SELECT symbol, count(ret) AS n, avg(ret) / nullif(stddev_samp(ret), 0) AS sr, skewness(ret) AS g1, kurtosis(ret) + 3 AS g2 FROM a WHERE age <= 252 GROUP BY symbol HAVING count(ret) >= 252), z AS (SELECT *, sr / sqrt((1 - g1 * sr + (g2 - 1) / 4 * sr * sr) / (n - 1)) AS z FROM g)", body="SELECT symbol, n, round(sr * sqrt(252), 6) AS sharpe, round(z, 6) AS z FROM z"))
def w20_psr(spark, d):
    """The latest year's Sharpe ratio and the deviate of its being above zero."""
    r = R.latest(with_returns(bars(spark, d)), 252).groupBy("symbol").agg(F.count("ret").alias("n"), F.try_divide(F.avg("ret"), F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2")).where("n >= 252")
    skew, kurt = unbiased(F.col("n"), F.col("g1"), F.col("g2"))
    sr = F.col("sr")
    return R.tidy(r, "symbol", "n", sharpe=sr * R.YEAR, z=sr / F.sqrt((1 - skew * sr + (kurt + 2) / 4 * sr * sr) / (F.col("n") - 1)))
