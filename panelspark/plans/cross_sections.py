"""Registered queries: cross-sections, aggregates and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import cross as C
from panelspark.operators import rolling as R
from panelspark.plans.panels import PAIRED, W, frame
from panelspark.registry import query
from panelspark.sources.views import actions, bars, bench, bench_returns, by_symbol, fundamentals, priced, sectors, sql, with_returns


@query("a1_pairwise_correlation", sql("r", body="SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0), 6) AS correlation, round(covar_samp(x.ret, y.ret) * 252, 6) AS covariance FROM r x JOIN r y USING (trade_date) WHERE x.symbol <= y.symbol AND x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60"))
def a1(spark, d):
    return C.pairwise(bars(spark, d), symbols=priced(spark, d).select(F.lit(0).alias("grp"), "symbol"))


@query("a2_action_velocity", sql("actions", ctes="g AS (SELECT date_trunc('month', effective_date)::DATE AS period, count(*) AS total, count(DISTINCT entity_id) AS entities, " + ", ".join(f"count(*) FILTER (action_type LIKE '{i}-%') AS type_{i}" for i in range(1, 6)) + " FROM actions GROUP BY 1)", body="SELECT *, round(type_2 / nullif(type_1 + type_2, 0), 6) AS ratio_2, round(avg(total) OVER (ORDER BY period ROWS 2 PRECEDING), 6) AS velocity FROM g"))
def a2(spark, d):
    g = actions(spark, d).groupBy(F.trunc("effective_date", "month").alias("period")).agg(F.count("*").alias("total"), F.count_distinct("entity_id").alias("entities"), *[F.count_if(F.col("action_type").startswith(f"{i}-")).alias(f"type_{i}") for i in range(1, 6)])
    w = Window.partitionBy(F.lit(1)).orderBy("period").rowsBetween(-2, 0)  # a row a month
    return g.withColumns({"ratio_2": F.round(F.try_divide("type_2", F.col("type_1") + F.col("type_2")), 6), "velocity": F.round(F.avg("total").over(w), 6)})


@query("a3_breadth", sql("r", ctes=f"t AS (SELECT *, avg(close) OVER {frame(50)} AS sma FROM r), g AS (SELECT trade_date, count(DISTINCT symbol) AS symbols, count(*) FILTER (close > sma) AS above_sma, count(*) FILTER (ret > 0) AS advancers, count(*) FILTER (ret < 0) AS decliners, count(*) FILTER (ret = 0) AS unchanged FROM t GROUP BY 1)", body="SELECT *, advancers - decliners AS net, round(100 * above_sma / symbols, 6) AS pct_above FROM g"))
def a3(spark, d):
    return C.breadth(bars(spark, d))


@query("a11_sector_summary", sql("r", "sectors", ctes="l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)", body="SELECT coalesce(sector, 'Other') AS sector, count(*) AS members, count(*) FILTER (ret > 0) AS advancers, count(*) FILTER (ret < 0) AS decliners, round(sum(ret * close * volume) / nullif(sum(close * volume), 0), 6) AS change FROM l LEFT JOIN sectors USING (symbol) GROUP BY 1"))
def a11(spark, d):
    r = R.latest(with_returns(bars(spark, d)), 1).join(sectors(spark, d), "symbol", "left")
    v = F.col("close") * F.col("volume")
    return r.groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.count("*").alias("members"), F.count_if(F.col("ret") > 0).alias("advancers"), F.count_if(F.col("ret") < 0).alias("decliners"), F.round(F.try_divide(F.sum(F.col("ret") * v), F.sum(v)), 6).alias("change"))


@query("r12_movers", sql("r", ctes="l AS (SELECT symbol, round(ret, 6) AS ret FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1), m AS (SELECT *, row_number() OVER (ORDER BY ret DESC, symbol) AS up, row_number() OVER (ORDER BY ret, symbol) AS down FROM l WHERE ret <> 0)", body="SELECT symbol, ret, CASE WHEN ret > 0 THEN 'gainer' ELSE 'loser' END AS side, CASE WHEN ret > 0 THEN up ELSE down END AS place FROM m WHERE (ret > 0 AND up <= 5) OR (ret < 0 AND down <= 5)"))
def r12(spark, d):
    r = R.latest(with_returns(bars(spark, d)), 1).select("symbol", F.round("ret", 6).alias("ret")).where("ret <> 0")
    r = r.withColumn("side", F.when(F.col("ret") > 0, "gainer").otherwise("loser"))
    w = Window.partitionBy("side").orderBy(F.desc(F.abs("ret")), "symbol")
    return r.withColumn("place", F.row_number().over(w)).where("place <= 5")


POOL = "SELECT company, sector, {cols} FROM fundamentals WHERE multiple > 0"


@query("r2_percentile_ranks", sql("fundamentals", ctes="f AS (SELECT *, count(*) OVER (PARTITION BY sector) AS n, rank() OVER (PARTITION BY sector ORDER BY multiple) - 1 AS b, count(*) OVER (PARTITION BY sector, multiple) AS e FROM fundamentals WHERE multiple > 0)", body="SELECT company, sector, round(100 * (b + 0.5 * e) / n, 1) AS pct_mean, round(100 * (b + e) / n, 1) AS pct_rank, round(100 * b / n, 1) AS pct_strict, round(100 - 100 * b / nullif(n - 1, 0), 6) AS cheapness, round((b + e) / n, 6) AS pool FROM f"))
def r2(spark, d):
    f = fundamentals(spark, d).where("multiple > 0")
    p = lambda m: C.percentile_rank(f, "multiple", ["sector"], m)
    return f.select("company", "sector", F.round(p("mean"), 1).alias("pct_mean"), F.round(p("rank"), 1).alias("pct_rank"), F.round(p("strict"), 1).alias("pct_strict"), F.round(100 - p("peer"), 6).alias("cheapness"), F.round(p("pool"), 6).alias("pool"))


@query("pf12_not_meaningful", sql("fundamentals", body="SELECT company, CASE WHEN multiple > 0 THEN multiple END AS multiple, CASE WHEN multiple IS NULL THEN 'missing' WHEN multiple <= 0 THEN 'NM' ELSE 'ok' END AS state FROM fundamentals"))
def pf12(spark, d):
    m = F.col("multiple")
    return fundamentals(spark, d).select("company", F.when(m > 0, m).alias("multiple"), F.when(m.isNull(), "missing").when(m <= 0, "NM").otherwise("ok").alias("state"))


VECTOR = """a AS (SELECT r.*, bench_ret, row_number() OVER (PARTITION BY symbol ORDER BY r.trade_date DESC) AS age FROM r LEFT JOIN br USING (trade_date)),
y AS (SELECT symbol, age, close / max(close) OVER (PARTITION BY symbol ORDER BY age DESC) - 1 AS dd FROM a WHERE age <= 252),
g AS (SELECT symbol, count(*) AS n, stddev_samp(ret) FILTER (age <= 21) * sqrt(252) * 100 AS vol_21d, stddev_samp(ret) FILTER (age <= 63) * sqrt(252) * 100 AS vol_63d, stddev_samp(ret) FILTER (age <= 252) * sqrt(252) * 100 AS vol_252d,
 stddev_samp(ret) * sqrt(252) * 100 AS annualised_vol, min(dd) * 100 AS max_drawdown, avg(ret) FILTER (age <= 252) AS m, var_pop(ret) FILTER (age <= 252) AS v, avg(ret * ret) FILTER (age <= 252) AS m2, avg(ret * ret * ret) FILTER (age <= 252) AS m3, avg(ret * ret * ret * ret) FILTER (age <= 252) AS m4,
 -100 * quantile_cont(ret, 0.05) FILTER (age <= 252) AS var_95, covar_samp(ret, bench_ret) FILTER (age <= 252) / var_samp(bench_ret) FILTER (age <= 252 AND ret IS NOT NULL) AS beta,
 max(close) FILTER (age = 22) AS p1, max(close) FILTER (age = 253) AS p0, avg(abs(ret) / (close * volume) * 1e6) FILTER (age <= 252 AND close * volume > 0) AS amihud FROM a LEFT JOIN y USING (symbol, age) GROUP BY symbol),
vec AS (SELECT symbol, n, round(vol_21d, 6) AS vol_21d, round(vol_63d, 6) AS vol_63d, round(vol_252d, 6) AS vol_252d, round(annualised_vol, 6) AS annualised_vol, round(max_drawdown, 6) AS max_drawdown, round(var_95, 6) AS var_95, round(beta, 6) AS beta,
 round((m3 - 3 * m * m2 + 2 * m * m * m) / nullif(pow(v, 1.5), 0), 6) AS skewness, round((m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / nullif(v * v, 0) - 3, 6) AS kurtosis, round(100 * (p1 / p0 - 1), 6) AS momentum_12_1, round(amihud * 1e3, 6) AS amihud FROM g)"""


@query("a33_metric_vector", sql("r", "br", ctes=VECTOR, body="SELECT * FROM vec"))
def a33(spark, d):
    return C.metric_vector(bars(spark, d), bench_returns(bench(spark, d)))


LONG = VECTOR + ", lm AS (SELECT symbol, sector, metric, value FROM (UNPIVOT vec ON " + ", ".join(C.METRICS) + " INTO NAME metric VALUE value) LEFT JOIN sectors USING (symbol))"


@query("a13_distributions", sql("r", "br", "sectors", ctes=LONG, body="SELECT metric, sector, count(*) AS n, array_agg(value ORDER BY value) AS pool FROM lm GROUP BY GROUPING SETS ((metric), (metric, sector))"))
def a13(spark, d):
    lm = C.long_metrics(a33(spark, d), sectors(spark, d))
    return lm.groupingSets([["metric"], ["metric", "sector"]], "metric", "sector").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value")).alias("pool"))


def _pct(by: str) -> str:
    return f"round(100 * (rank() OVER (PARTITION BY {by} ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY {by}, value)) / count(*) OVER (PARTITION BY {by}), 1)"


@query("r5_metric_percentiles", sql("r", "br", "sectors", ctes=LONG, body=f"SELECT symbol, metric, value, CASE WHEN count(*) OVER (PARTITION BY metric) >= 10 THEN {_pct('metric')} END AS vs_universe, CASE WHEN count(*) OVER (PARTITION BY metric, sector) >= 5 THEN {_pct('metric, sector')} END AS vs_sector FROM lm"))
def r5(spark, d):
    lm = C.long_metrics(a33(spark, d), sectors(spark, d))
    return lm.select("symbol", "metric", "value", F.round(C.percentile_rank(lm, "value", ["metric"], "mean", 10), 1).alias("vs_universe"), F.round(C.percentile_rank(lm, "value", ["metric", "sector"], "mean", 5), 1).alias("vs_sector"))


PANEL = f"panel AS (SELECT symbol, trade_date, round(-(close / lag(close, 21) OVER {W} - 1), 6) AS sig, " + ", ".join(f"round(lead(close, {h}) OVER {W} / close - 1, 6) AS f{h}" for h in (1, 5, 21)) + " FROM bars)"


def panel(spark, d):
    """Research panel: reversal signal and forward returns."""
    b = bars(spark, d)
    return R.tidy(b, "symbol", "trade_date", sig=-(F.try_divide("close", F.lag("close", 21).over(by_symbol())) - 1), **{f"f{h}": F.try_divide(F.lead("close", h).over(by_symbol()), "close") - 1 for h in (1, 5, 21)})


def _ic_sql(h: int) -> str:
    return f"SELECT {h} AS horizon, trade_date, count(*) AS n, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS ic FROM (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY sig) + (count(*) OVER (PARTITION BY trade_date, sig) - 1) / 2 AS x, rank() OVER (PARTITION BY trade_date ORDER BY f{h}) + (count(*) OVER (PARTITION BY trade_date, f{h}) - 1) / 2 AS y FROM panel WHERE sig IS NOT NULL AND f{h} IS NOT NULL) GROUP BY trade_date HAVING count(*) >= 10"


@query("r6_rank_ic", sql("bars", ctes=PANEL, body=f"SELECT trade_date, n, round(ic, 6) AS ic FROM ({_ic_sql(1)})"))
def r6(spark, d):
    return C.rank_ic(panel(spark, d), "sig", "f1")


@query("r7_ic_decay", sql("bars", ctes=PANEL, body="SELECT horizon, count(*) AS dates, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS ir FROM (" + " UNION ALL ".join(_ic_sql(h) for h in (1, 5, 21)) + ") GROUP BY horizon"))
def r7(spark, d):
    p = panel(spark, d)
    out = None
    for h in (1, 5, 21):
        x = C.rank_ic(p, "sig", f"f{h}").withColumn("horizon", F.lit(h))
        out = x if out is None else out.unionByName(x)
    return R.tidy(out.groupBy("horizon").agg(F.count("*").alias("dates"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s")), "horizon", "dates", mean_ic=F.col("m"), ir=F.try_divide("m", "s"))


BUCKETS = "b AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY sig, symbol) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM panel WHERE sig IS NOT NULL), b2 AS (SELECT *, greatest(1, ceil((k - 1) * 10 / greatest(1, n - 1)))::INT AS bucket FROM b)"


@query("r8_decile_spreads", sql("bars", ctes=PANEL + ", " + BUCKETS, body="SELECT trade_date, round(avg(f1) FILTER (bucket = 10) - avg(f1) FILTER (bucket = 1), 8) AS spread, round(avg(f1) FILTER (bucket = 1), 8) AS low, round(avg(f1) FILTER (bucket = 10), 8) AS high FROM b2 WHERE n >= 20 GROUP BY trade_date"))
def r8(spark, d):
    b = C.buckets(panel(spark, d), "sig", 10).where("n >= 20")
    hi, lo = F.avg(F.when(F.col("bucket") == 10, F.col("f1"))), F.avg(F.when(F.col("bucket") == 1, F.col("f1")))
    return R.tidy(b.groupBy("trade_date").agg(hi.alias("h"), lo.alias("l")), "trade_date", digits=8, spread=F.col("h") - F.col("l"), low=F.col("l"), high=F.col("h"))


@query("r8_bucket_means", sql("bars", ctes=PANEL + ", " + BUCKETS, body="SELECT bucket, count(f1) AS n, round(avg(f1), 6) AS mean_f1 FROM b2 WHERE n >= 20 GROUP BY bucket"))
def r8b(spark, d):
    return C.buckets(panel(spark, d), "sig", 10).where("n >= 20").groupBy("bucket").agg(F.count("f1").alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"))


WEIGHTS = "wt AS (SELECT symbol, trade_date, CASE bucket WHEN 10 THEN 1.0 ELSE -1.0 END / count(*) OVER (PARTITION BY trade_date, bucket) AS w FROM b2 WHERE n >= 20 AND bucket IN (1, 10)), dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM wt)), ww AS (SELECT symbol, k, w FROM wt JOIN dd USING (trade_date))"


@query("r9_turnover", sql("bars", ctes=PANEL + ", " + BUCKETS + ", " + WEIGHTS + ", ch AS (SELECT coalesce(a.k, b.k + 1) AS k, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS turnover FROM ww a FULL JOIN ww b ON a.symbol = b.symbol AND a.k = b.k + 1 GROUP BY 1)", body="SELECT trade_date, round(turnover, 6) AS turnover, round(turnover * 2 * 10 / 1e4, 8) AS cost FROM ch JOIN dd USING (k)"))
def r9(spark, d):
    b = C.buckets(panel(spark, d), "sig", 10).where("n >= 20 AND bucket IN (1, 10)")
    n = F.count("*").over(Window.partitionBy("trade_date", "bucket"))
    wt = b.select("symbol", "trade_date", (F.when(F.col("bucket") == 10, 1.0).otherwise(-1.0) / n).alias("w"))
    dates = wt.select("trade_date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("trade_date")))
    ww = wt.join(dates, "trade_date").select("symbol", "k", "w")
    prev = ww.select("symbol", (F.col("k") + 1).alias("k"), F.col("w").alias("w0"))
    both = ww.join(prev, ["symbol", "k"], "full").groupBy("k").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))) / 2).alias("t"))
    return both.join(dates, "k").select("trade_date", F.round("t", 6).alias("turnover"), F.round(F.col("t") * 2 * 10 / 1e4, 8).alias("cost"))


@query("st6_newey_west")
def st6(spark, d):
    return C.newey_west(with_returns(bars(spark, d)), "ret", ["symbol"], "trade_date")


PERF = "u AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS dd FROM t), g AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + {x}))) AS w, avg({x}) - 0.04 / 252 AS m, stddev_samp({x}) AS s, stddev_samp({x} - 0.04 / 252) FILTER ({x} < 0.04 / 252) AS down, min(dd) AS dd FROM u GROUP BY symbol)"
PERF_BODY = "SELECT symbol, n, round(w - 1, 6) AS total, round(pow(w, 252 / n) - 1, 6) AS cagr, round(s * sqrt(252), 6) AS vol, round(coalesce(m / nullif(s, 0), 0) * sqrt(252), 6) AS sharpe, round(coalesce(m / nullif(down, 0), 0) * sqrt(252), 6) AS sortino, round(dd, 6) AS max_drawdown, round(coalesce((pow(w, 252 / n) - 1) / nullif(-dd, 0), 0), 6) AS calmar FROM g"


@query("a23_performance", sql("r", ctes=f"t AS (SELECT *, exp(sum(ln(1 + ret)) OVER {W}) AS wealth FROM r WHERE ret > -1), " + PERF.format(x="ret"), body=PERF_BODY))
def a23(spark, d):
    return C.perf_stats(with_returns(bars(spark, d)), ["symbol"], "ret", "trade_date")


@query("a24_relative_stats", sql("r", "br", ctes=PAIRED, body="SELECT symbol, count(*) AS n, round(covar_samp(ret, bench_ret) / var_samp(bench_ret), 6) AS beta, round((avg(ret) - covar_samp(ret, bench_ret) / var_samp(bench_ret) * avg(bench_ret)) * 252, 6) AS alpha, round(avg(ret - bench_ret) / stddev_samp(ret - bench_ret) * sqrt(252), 6) AS information_ratio, round(covar_samp(ret, bench_ret) / (stddev_samp(ret) * stddev_samp(bench_ret)), 6) AS correlation FROM p GROUP BY symbol"))
def a24(spark, d):
    r = with_returns(bars(spark, d)).join(bench_returns(bench(spark, d)), "trade_date").where("ret IS NOT NULL AND bench_ret IS NOT NULL")
    g = r.groupBy("symbol").agg(F.count("*").alias("n"), F.covar_samp("ret", "bench_ret").alias("c"), F.var_samp("bench_ret").alias("v"), F.avg("ret").alias("m"), F.avg("bench_ret").alias("mb"), F.stddev_samp("ret").alias("s"), F.avg(F.col("ret") - F.col("bench_ret")).alias("d"), F.stddev_samp(F.col("ret") - F.col("bench_ret")).alias("sd"))
    beta = F.try_divide("c", "v")
    return R.tidy(g, "symbol", "n", beta=beta, alpha=(F.col("m") - beta * F.col("mb")) * 252, information_ratio=F.try_divide("d", "sd") * R.YEAR, correlation=F.try_divide("c", F.col("s") * F.sqrt("v")))


@query("a35_return_moments", sql("r", body="SELECT symbol, count(ret) AS n, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS sd, round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurt FROM r GROUP BY symbol"))
def a35(spark, d):
    g = with_returns(bars(spark, d)).groupBy("symbol").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1")
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return R.tidy(g, "symbol", "n", mean=F.col("m"), sd=F.col("s"), skew=skew, kurt=kurt)


@query("a26_price_ranges", sql("r", ctes="a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM r)", body="SELECT symbol, round(max(high), 6) AS high_all, round(min(low), 6) AS low_all, round(max(high) FILTER (age <= 252), 6) AS high_52w, round(min(low) FILTER (age <= 252), 6) AS low_52w, round(avg(greatest(high - low, abs(high - prev_close), abs(low - prev_close))) FILTER (age <= 30), 6) AS atr_30 FROM a GROUP BY symbol"))
def a26(spark, d):
    r = with_returns(bars(spark, d)).withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date"))))
    near = lambda c, n: F.when(F.col("age") <= n, c)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))
    g = r.groupBy("symbol").agg(F.max("high").alias("a"), F.min("low").alias("b"), F.max(near(F.col("high"), 252)).alias("c"), F.min(near(F.col("low"), 252)).alias("e"), F.avg(near(tr, 30)).alias("t"))
    return R.tidy(g, "symbol", high_all=F.col("a"), low_all=F.col("b"), high_52w=F.col("c"), low_52w=F.col("e"), atr_30=F.col("t"))


@query("a28_return_histogram", sql("r", ctes="x AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi FROM r GROUP BY symbol), y AS (SELECT symbol, least(79, floor((ret - lo) / nullif(hi - lo, 0) * 80))::INT AS bin FROM r JOIN x USING (symbol) WHERE ret IS NOT NULL)", body="SELECT symbol, bin, count(*) AS n FROM y GROUP BY ALL"))
def a28(spark, d):
    w = Window.partitionBy("symbol")
    r = with_returns(bars(spark, d)).withColumns({"lo": F.min("ret").over(w), "hi": F.max("ret").over(w)}).where("ret IS NOT NULL")
    return r.groupBy("symbol", F.least(F.lit(79), F.floor(F.try_divide(F.col("ret") - F.col("lo"), F.col("hi") - F.col("lo")) * 80)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("a29_a30_liquidity", sql("r", ctes="a AS (SELECT *, close * volume AS dv, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM r), g AS (SELECT symbol, avg(dv) FILTER (age <= 20) AS adv20, avg(dv) FILTER (age <= 60) AS adv60, avg(abs(ret) / dv * 1e6) FILTER (age <= 60 AND dv > 0) AS am60, avg(abs(ret) / dv * 1e6) FILTER (dv > 0) AS am, CASE WHEN count(ret) FILTER (age <= 252 AND dv > 0) >= 63 THEN avg(abs(ret) / dv * 1e6) FILTER (age <= 252 AND dv > 0) END AS am252 FROM a GROUP BY symbol)", body="SELECT symbol, round(adv20, 4) AS adv_20, round(adv60, 4) AS adv_60, round(1e7 / (0.1 * adv20), 6) AS days_to_exit, round(am60, 6) AS amihud_60, round(am, 6) AS amihud_all, round(am252, 6) AS amihud_252, adv20 < 1e6 AS illiquid FROM g"))
def a29(spark, d):
    r = with_returns(bars(spark, d)).withColumns({"dv": F.col("close") * F.col("volume"), "age": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))})
    near = lambda c, n: F.when(F.col("age") <= n, c)
    am = F.when(F.col("dv") > 0, F.abs("ret") / F.col("dv") * 1e6)
    g = r.groupBy("symbol").agg(F.avg(near(F.col("dv"), 20)).alias("adv20"), F.avg(near(F.col("dv"), 60)).alias("adv60"), F.avg(near(am, 60)).alias("am60"), F.avg(am).alias("am"), F.when(F.count(near(am, 252)) >= 63, F.avg(near(am, 252))).alias("am252"))
    return g.select("symbol", F.round("adv20", 4).alias("adv_20"), F.round("adv60", 4).alias("adv_60"), F.round(1e7 / (0.1 * F.col("adv20")), 6).alias("days_to_exit"), F.round("am60", 6).alias("amihud_60"), F.round("am", 6).alias("amihud_all"), F.round("am252", 6).alias("amihud_252"), (F.col("adv20") < 1e6).alias("illiquid"))


K0 = 3 - 2 * 2**0.5


@query("a31_corwin_schultz", sql("r", ctes=f"t AS (SELECT symbol, pow(ln(high / low), 2) + pow(ln(lag(high) OVER {W} / lag(low) OVER {W}), 2) AS b, pow(ln(greatest(high, lag(high) OVER {W}) / least(low, lag(low) OVER {W})), 2) AS g, rn FROM r), u AS (SELECT symbol, (sqrt(2 * b) - sqrt(b)) / {K0!r}::DOUBLE - sqrt(g / {K0!r}::DOUBLE) AS a FROM t WHERE rn > 1)", body="SELECT symbol, round(least(0.2, avg(greatest(0, 2 * (exp(a) - 1) / (1 + exp(a))))), 6) AS spread FROM u GROUP BY symbol"))
def a31(spark, d):
    w = by_symbol()
    ph, pl = F.lag("high").over(w), F.lag("low").over(w)
    sq = lambda c: F.pow(c, F.lit(2))
    r = with_returns(bars(spark, d)).withColumns({"b": sq(F.ln(F.col("high") / F.col("low"))) + sq(F.ln(ph / pl)), "g": sq(F.ln(F.greatest("high", ph) / F.least("low", pl)))}).where("rn > 1")
    a = (F.sqrt(2 * F.col("b")) - F.sqrt("b")) / K0 - F.sqrt(F.col("g") / K0)
    return r.withColumn("a", a).groupBy("symbol").agg(F.round(F.least(F.lit(0.2), F.avg(F.greatest(F.lit(0.0), 2 * (F.exp("a") - 1) / (1 + F.exp("a"))))), 6).alias("spread"))


@query("a32_roll_spread", sql("r", ctes=f"t AS (SELECT symbol, trade_date, close - prev_close AS dp FROM r), u AS (SELECT symbol, dp, lag(dp) OVER {W} AS dp0, dp FROM t)", body="SELECT symbol, round(2 * sqrt(greatest(0, -covar_samp(dp, dp0))), 6) AS spread FROM u GROUP BY symbol"))
def a32(spark, d):
    r = with_returns(bars(spark, d)).withColumn("dp", F.col("close") - F.col("prev_close"))
    r = r.withColumn("dp0", F.lag("dp").over(by_symbol()))
    return r.groupBy("symbol").agg(F.round(2 * F.sqrt(F.greatest(F.lit(0.0), -F.covar_samp("dp", "dp0"))), 6).alias("spread"))


MONTHLY = "m AS (SELECT symbol, date_trunc('month', trade_date)::DATE AS mo, arg_max(close, trade_date) AS c, max(trade_date) AS dt FROM bars GROUP BY ALL), m2 AS (SELECT *, c / lag(c) OVER (PARTITION BY symbol ORDER BY mo) - 1 AS x, max(mo) OVER (PARTITION BY symbol) AS last_mo FROM m)"


@query("a21_seasonality", sql("bars", ctes=MONTHLY, body="SELECT symbol, month(mo)::INT AS month, count(x) AS n, round(avg(x), 6) AS mean_return FROM m2 WHERE mo < last_mo AND x IS NOT NULL GROUP BY ALL"))
def a21(spark, d):
    m = bars(spark, d).groupBy("symbol", F.trunc("trade_date", "month").alias("mo")).agg(F.max_by("close", "trade_date").alias("c"))
    m = m.withColumns({"x": F.try_divide("c", F.lag("c").over(Window.partitionBy("symbol").orderBy("mo"))) - 1, "last": F.max("mo").over(Window.partitionBy("symbol"))})
    return m.where("mo < last AND x IS NOT NULL").groupBy("symbol", F.month("mo").alias("month")).agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean_return"))


@query("a22_capture_ratios", sql("r", "br", ctes=PAIRED + ", m AS (SELECT symbol, date_trunc('month', trade_date) AS mo, exp(sum(ln(1 + ret))) AS a, exp(sum(ln(1 + bench_ret))) AS b, count(*) AS days FROM p GROUP BY ALL), g AS (SELECT symbol, count(*) FILTER (b > 1) AS up, count(*) FILTER (b < 1) AS down, avg(ln(a) - ln(b)) FILTER (b > 1) AS u, avg(ln(a) - ln(b)) FILTER (b < 1) AS d FROM m GROUP BY symbol HAVING sum(days) >= 20)", body="SELECT symbol, up, down, round(CASE WHEN up >= 6 THEN 100 * exp(u) END, 6) AS up_capture, round(CASE WHEN down >= 6 THEN 100 * exp(d) END, 6) AS down_capture FROM g"))
def a22(spark, d):
    r = with_returns(bars(spark, d)).join(bench_returns(bench(spark, d)), "trade_date").where("ret IS NOT NULL AND bench_ret IS NOT NULL")
    m = r.groupBy("symbol", F.trunc("trade_date", "month").alias("mo")).agg(F.exp(F.sum(F.ln(1 + F.col("ret")))).alias("a"), F.exp(F.sum(F.ln(1 + F.col("bench_ret")))).alias("b"), F.count("*").alias("days"))
    # geometric means of 1 + return, the symbol's over the benchmark's, in six months at least
    part = lambda ok: F.avg(F.when(ok, F.ln("a") - F.ln("b")))
    up, down = F.col("b") > 1, F.col("b") < 1
    g = m.groupBy("symbol").agg(F.sum("days").alias("days"), F.count_if(up).alias("up"), F.count_if(down).alias("down"), part(up).alias("u"), part(down).alias("d")).where("days >= 20")
    return R.tidy(g, "symbol", "up", "down", up_capture=F.when(F.col("up") >= 6, 100 * F.exp("u")), down_capture=F.when(F.col("down") >= 6, 100 * F.exp("d")))


@query("a27_volume_profile", sql("bars", ctes="x AS (SELECT symbol, min(low) AS lo, (max(high) - min(low)) / 50 AS step FROM bars GROUP BY symbol), y AS (SELECT symbol, bin::INT AS bin, sum(volume * CASE WHEN high > low THEN (least(high, lo + (bin + 1) * step) - greatest(low, lo + bin * step)) / (high - low) ELSE 1 END) AS v FROM bars JOIN x USING (symbol), range(50) b(bin) WHERE step > 0 AND bin BETWEEN least(49, floor((low - lo) / step)) AND least(49, floor((high - lo) / step)) GROUP BY ALL)", body="SELECT symbol, bin, round(v, 4) AS volume, v = max(v) OVER (PARTITION BY symbol) AS poc FROM y"))
def a27(spark, d):
    b, w = bars(spark, d), Window.partitionBy("symbol")
    b = b.withColumns({"lo": F.min("low").over(w), "step": (F.max("high").over(w) - F.min("low").over(w)) / 50}).where("step > 0")
    at = lambda c: F.least(F.lit(49), F.floor((F.col(c) - F.col("lo")) / F.col("step"))).cast("int")
    b = b.withColumn("bin", F.explode(F.sequence(at("low"), at("high"))))
    part = F.when(F.col("high") > F.col("low"), (F.least(F.col("high"), F.col("lo") + (F.col("bin") + 1) * F.col("step")) - F.greatest(F.col("low"), F.col("lo") + F.col("bin") * F.col("step"))) / (F.col("high") - F.col("low"))).otherwise(1.0)
    g = b.groupBy("symbol", "bin").agg(F.sum(F.col("volume") * part).alias("v"))
    return g.select("symbol", "bin", F.round("v", 4).alias("volume"), (F.col("v") == F.max("v").over(w)).alias("poc"))


@query("pf3_min_history", sql("bars", body="SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 252"))
def pf3(spark, d):
    return bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 252")


@query("pf4_pf5_liquid_universe", sql("bars", body="SELECT symbol, trade_date, close >= 5 AND volume >= 20 AS is_liquid FROM bars WHERE symbol NOT IN ('S000000', 'S000001')"))
def pf5(spark, d):
    return bars(spark, d).where(~F.col("symbol").isin("S000000", "S000001")).select("symbol", "trade_date", ((F.col("close") >= 5) & (F.col("volume") >= 20)).alias("is_liquid"))


@query("pf18_r10_screener", sql("r", ctes=f"t AS (SELECT symbol, trade_date, lag(close, 21) OVER {W} / lag(close, 252) OVER {W} - 1 AS m, stddev_samp(ret) OVER {frame(63)} * sqrt(252) AS v, close > avg(close) OVER {frame(200)} AS above FROM r), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)", body="SELECT symbol, round(m, 6) AS momentum, round(v, 6) AS vol, round(m / v, 6) AS score, above, row_number() OVER (ORDER BY m / v DESC, symbol) AS place FROM l WHERE m >= -0.5 AND v <= 10"))
def pf18(spark, d):
    r = with_returns(bars(spark, d))
    lag = lambda n: F.lag("close", n).over(by_symbol())
    r = r.withColumns({"m": F.try_divide(lag(21), lag(252)) - 1, "v": F.stddev_samp("ret").over(R.last(63)) * R.YEAR, "above": F.col("close") > F.avg("close").over(R.last(200))})
    r = R.latest(r, 1).where("m >= -0.5 AND v <= 10").withColumn("s", F.col("m") / F.col("v"))
    return R.tidy(r.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("s"), "symbol"))), "symbol", "above", "place", momentum=F.col("m"), vol=F.col("v"), score=F.col("s"))


@query("r15_peer_table", sql("fundamentals", ctes="f AS (SELECT *, percent_rank() OVER (PARTITION BY industry ORDER BY multiple) AS pr, count(*) OVER (PARTITION BY industry) AS peers FROM fundamentals WHERE multiple > 0)", body="SELECT company, industry, peers, round(100 - 100 * pr, 6) AS cheapness, CASE WHEN pr < 0.25 THEN 'cheap' WHEN pr > 0.75 THEN 'rich' ELSE 'fair' END AS band FROM f WHERE peers >= 3"))
def r15(spark, d):
    w = Window.partitionBy("industry")
    f = fundamentals(spark, d).where("multiple > 0").withColumns({"pr": F.percent_rank().over(w.orderBy("multiple")), "peers": F.count("*").over(w)}).where("peers >= 3")
    return f.select("company", "industry", "peers", F.round(100 - 100 * F.col("pr"), 6).alias("cheapness"), F.when(F.col("pr") < 0.25, "cheap").when(F.col("pr") > 0.75, "rich").otherwise("fair").alias("band"))


@query("r16_value_screen", sql("fundamentals", ctes="f AS (SELECT *, count(*) OVER (PARTITION BY sector, industry) AS ni, count(*) OVER (PARTITION BY sector) AS ns, 100 - 100 * percent_rank() OVER (PARTITION BY sector, industry ORDER BY multiple) AS pi, 100 - 100 * percent_rank() OVER (PARTITION BY sector ORDER BY multiple) AS ps FROM fundamentals WHERE multiple > 0), s AS (SELECT company, sector, CASE WHEN ni >= 8 THEN 'industry' WHEN ns >= 8 THEN 'sector' END AS cohort, round(CASE WHEN ni >= 8 THEN pi WHEN ns >= 8 THEN ps END, 6) AS score FROM f)", body="SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, company) AS place FROM s WHERE cohort IS NOT NULL QUALIFY place <= 50"))
def r16(spark, d):
    wi, ws = Window.partitionBy("sector", "industry"), Window.partitionBy("sector")
    f = fundamentals(spark, d).where("multiple > 0").withColumns({"ni": F.count("*").over(wi), "ns": F.count("*").over(ws), "pi": 100 - 100 * F.percent_rank().over(wi.orderBy("multiple")), "ps": 100 - 100 * F.percent_rank().over(ws.orderBy("multiple"))})
    pick = lambda a, b: F.when(F.col("ni") >= 8, a).when(F.col("ns") >= 8, b)
    f = f.select("company", "sector", pick(F.lit("industry"), F.lit("sector")).alias("cohort"), F.round(pick(F.col("pi"), F.col("ps")), 6).alias("score")).where("cohort IS NOT NULL")
    return f.withColumn("place", F.row_number().over(ws.orderBy(F.desc("score"), "company"))).where("place <= 50")


@query("a14_exclusion_ledger", sql("bars", "fundamentals", body="SELECT reason, count(*) AS n FROM (SELECT 'thin history' AS reason FROM bars GROUP BY symbol HAVING count(*) < 600 UNION ALL SELECT 'not meaningful' FROM fundamentals WHERE multiple <= 0 UNION ALL SELECT 'missing' FROM fundamentals WHERE multiple IS NULL) GROUP BY reason"))
def a14(spark, d):
    thin = bars(spark, d).groupBy("symbol").count().where("count < 600").select(F.lit("thin history").alias("reason"))
    f = fundamentals(spark, d).select(F.when(F.col("multiple").isNull(), "missing").when(F.col("multiple") <= 0, "not meaningful").alias("reason")).where("reason IS NOT NULL")
    return thin.unionByName(f).groupBy("reason").agg(F.count("*").alias("n"))


@query("r19_action_order", sql("actions", body="SELECT entity_id, action_id, row_number() OVER (PARTITION BY entity_id ORDER BY effective_date, substr(action_type, 1, 1)::INT, action_id) AS place FROM actions"))
def r19(spark, d):
    w = Window.partitionBy("entity_id").orderBy("effective_date", F.substring("action_type", 1, 1).cast("int"), "action_id")
    return actions(spark, d).select("entity_id", "action_id", F.row_number().over(w).alias("place"))
