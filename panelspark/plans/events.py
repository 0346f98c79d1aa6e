"""Registered queries: event studies, earnings, prints, filings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf, cdf_sql
from panelspark.operators import ranks
from panelspark.operators import rolling as R
from panelspark.operators import studies as S
from panelspark.operators.asof import asof
from panelspark.plans.joins import EVENTS, events
from panelspark.plans.panels import PAIRED, W
from panelspark.registry import query
from panelspark.sources.views import CUSTOMER, bars, bench, bench_returns, by_symbol, customer_symbol, prints, read, sql, with_returns

def _windows() -> str:
    over = {k: f"(PARTITION BY symbol ORDER BY k ROWS BETWEEN {a} AND {b})" for k, a, b in (("e", "120 PRECEDING", "21 PRECEDING"), ("v", "10 PRECEDING", "30 FOLLOWING"), ("d", "2 FOLLOWING", "21 FOLLOWING"))}
    cols = (("n", "count(ret)", "e"), ("mx", "avg(bench_ret)", "e"), ("my", "avg(ret)", "e"), ("c", "covar_pop(ret, bench_ret)", "e"), ("vx", "var_pop(bench_ret)", "e"), ("vy", "var_pop(ret)", "e"), ("l", "count(ret)", "v"), ("sx", "sum(bench_ret)", "v"), ("sy", "sum(ret)", "v"), ("sxx", "sum(bench_ret * bench_ret)", "v"), ("dl", "count(ret)", "d"), ("dx", "sum(bench_ret)", "d"), ("dy", "sum(ret)", "d"))
    return "w AS (SELECT symbol, trade_date, k, " + ", ".join(f"{f} OVER {over[o]} AS {n}" for n, f, o in cols) + " FROM p)"


STUDY = EVENTS + ", " + PAIRED + ", " + _windows() + f""", e AS (SELECT DISTINCT symbol, event_type, event_date, after_close FROM ev),
t0 AS (SELECT e.*, w.* EXCLUDE (symbol) FROM (SELECT * FROM e WHERE after_close) e ASOF JOIN w ON e.symbol = w.symbol AND event_date < trade_date UNION ALL SELECT e.*, w.* EXCLUDE (symbol) FROM (SELECT * FROM e WHERE NOT after_close) e ASOF JOIN w ON e.symbol = w.symbol AND event_date >= trade_date),
g2 AS (SELECT *, c / vx AS beta, my - c / vx * mx AS alpha FROM t0 WHERE n = 100 AND l = 41), g3 AS (SELECT *, sy - l * alpha - beta * sx AS car, greatest(0, n * (vy - beta * c)) / (n - 2) AS s2, greatest(0, sxx - 2 * mx * sx + l * mx * mx) / greatest(n * vx, 1e-8) AS spread FROM g2),
g4 AS (SELECT *, car / sqrt(greatest(1e-12, s2 * (l + l / n + spread))) AS t FROM g3),
cars AS (SELECT symbol, event_type, event_date, after_close, trade_date AS session, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(c * c / (vx * vy), 6) AS r2, round(car, 6) AS car, round(t, 6) AS t, round(2 * (1 - {cdf_sql('abs(t)')}), 6) AS p, round(CASE WHEN dl = 20 THEN dy - dl * alpha - beta * dx END, 6) AS drift FROM g4)"""


def study(spark, d, days: bool = False):
    e = events(spark, d).select("symbol", "event_type", "event_date", "after_close").repartition("symbol").distinct()
    return S.event_study(e, S.paired_sessions(bars(spark, d), bench_returns(bench(spark, d))), days=days)


@query("es1_event_study", sql("r", "br", ctes=STUDY, body="SELECT * FROM cars"))
def es1(spark, d):
    return study(spark, d)


@query("es1_daily_abnormal", sql("r", "br", ctes=STUDY, body="SELECT s.symbol, event_type, event_date, after_close, (p.k - s.k)::INT AS day, p.trade_date, round(p.ret - a - b * p.bench_ret, 6) AS abnormal, round(sum(p.ret - a - b * p.bench_ret) OVER (PARTITION BY s.symbol, event_type, event_date, after_close ORDER BY p.k), 6) AS cumulative FROM (SELECT *, round(alpha, 6) AS a, round(beta, 6) AS b FROM g4) s JOIN p ON p.symbol = s.symbol AND p.k BETWEEN s.k - 10 AND s.k + 30"))
def es1_daily(spark, d):
    return S.abnormal_days(study(spark, d, days=True))


@query("a15_es3_pooled_cars", sql("r", "br", ctes=STUDY + ", q AS (SELECT event_type, count(*) AS n, array_agg(car ORDER BY car) AS cars, avg(car) AS m, stddev_samp(car) AS s FROM cars GROUP BY 1 HAVING count(*) >= 2)", body=f"SELECT event_type, n, cars, round(m, 6) AS mean, round(s, 6) AS sd, round(m / (s / sqrt(n)), 6) AS t, round(2 * (1 - {cdf_sql('abs(m / (s / sqrt(n)))')}), 6) AS p FROM q"))
def es3(spark, d):
    return S.pooled(study(spark, d))


@query("es4_r4_car_percentile", sql("r", "br", ctes=STUDY, body="SELECT symbol, event_type, event_date, after_close, car, round(100 * cume_dist() OVER (PARTITION BY event_type ORDER BY car), 6) AS pooled_pct FROM cars"))
def es4(spark, d):
    return study(spark, d).select("symbol", "event_type", "event_date", "after_close", "car", F.round(100 * F.cume_dist().over(Window.partitionBy("event_type").orderBy("car")), 6).alias("pooled_pct"))


@query("es2_collapsed_events", "WITH RECURSIVE " + EVENTS + ", e AS (SELECT DISTINCT symbol, event_type, event_date FROM ev), k AS (SELECT symbol, event_type, min(event_date) AS event_date FROM e GROUP BY ALL UNION ALL SELECT k.symbol, k.event_type, (SELECT min(e.event_date) FROM e WHERE e.symbol = k.symbol AND e.event_type = k.event_type AND e.event_date > k.event_date + 60) FROM k WHERE k.event_date IS NOT NULL) SELECT symbol, event_type, event_date, (event_date + 60)::DATE AS end_date FROM k WHERE event_date IS NOT NULL")
def es2(spark, d):
    return S.collapse(events(spark, d))


EARN = f"""earn0 AS (SELECT {CUSTOMER} AS symbol, * FROM orders), earn AS (SELECT symbol, max(o_orderdate)::DATE AS date, sum(round(o_totalprice * 100)::BIGINT) / count(*) / 100 AS estimate,
 sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) / 100 AS actual FROM earn0 GROUP BY symbol, date_trunc('quarter', o_orderdate)),
earn2 AS (SELECT *, CASE WHEN abs(estimate) >= 0.05 THEN round(actual / estimate - 1, 6) END AS surprise, actual IS NULL AS upcoming FROM earn)"""


def earnings(spark, d):
    """(symbol, date, estimate, actual, surprise, upcoming): a print a symbol and quarter;
    the actual is the mean of finished orders, the estimate that of all."""
    o = read(spark, d, "orders").withColumn("symbol", customer_symbol(spark, d, "o_custkey")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    done = F.col("o_orderstatus") == "F"
    e = o.groupBy("symbol", F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.to_date(F.max("o_orderdate")).alias("date"), (F.sum("cents") / F.count("*") / 100).alias("estimate"), (F.try_divide(F.sum(F.when(done, F.col("cents"))), F.count_if(done)) / 100).alias("actual"))
    return e.select("symbol", "date", "estimate", "actual", F.when(F.abs("estimate") >= 0.05, F.round(F.col("actual") / F.col("estimate") - 1, 6)).alias("surprise"), F.col("actual").isNull().alias("upcoming"))


@query("src12_pf13_earnings", "WITH " + EARN + " SELECT symbol, date, round(estimate, 4) AS estimate, round(actual, 4) AS actual, surprise, upcoming FROM earn2")
def src12(spark, d):
    return earnings(spark, d).withColumns({"estimate": F.round("estimate", 4), "actual": F.round("actual", 4)})


METRICS = f"mx AS (SELECT symbol, trade_date, ret AS reaction, open / prev_close - 1 AS gap, lag(close) OVER {W} / lag(close, 6) OVER {W} - 1 AS runup, volume / avg(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rel_volume, lead(close, 5) OVER {W} / close - 1 AS drift_5, lead(close, 20) OVER {W} / close - 1 AS drift_20 FROM r)"


def event_metrics(spark, d):
    w = by_symbol()
    r = with_returns(bars(spark, d))
    r = r.withColumns({"reaction": F.col("ret"), "gap": F.col("open") / F.col("prev_close") - 1, "runup": F.lag("close").over(w) / F.lag("close", 6).over(w) - 1, "rel_volume": F.col("volume") / F.avg("volume").over(R.before(20)), "drift_5": F.lead("close", 5).over(w) / F.col("close") - 1, "drift_20": F.lead("close", 20).over(w) / F.col("close") - 1})
    e = earnings(spark, d).where("NOT upcoming").select("symbol", "date", "surprise")
    cols = ["reaction", "gap", "runup", "rel_volume", "drift_5", "drift_20"]
    e = asof(e, "date", r.select("symbol", "trade_date", *cols), "trade_date", ["symbol"], ["trade_date", *cols], forward=True, together=True)
    return R.tidy(e, "symbol", "date", "surprise", "trade_date", **{c: F.col(c) for c in cols})


EM = "em AS (SELECT e.symbol, e.date, surprise, trade_date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("reaction", "gap", "runup", "rel_volume", "drift_5", "drift_20")) + " FROM (SELECT * FROM earn2 WHERE NOT upcoming) e ASOF LEFT JOIN mx ON e.symbol = mx.symbol AND e.date <= trade_date)"
ALL_EM = EARN + ", " + METRICS + ", " + EM


@query("w30_event_metrics", sql("r", ctes=ALL_EM, body="SELECT * FROM em"))
def w30(spark, d):
    return event_metrics(spark, d)


@query("a16_drift_summary", sql("r", ctes=ALL_EM, body="SELECT symbol, count(*) AS events, round(avg(drift_20) FILTER (surprise > 0), 10) AS drift_beat, round(avg(drift_20) FILTER (surprise < 0), 10) AS drift_miss FROM em GROUP BY symbol"))
def a16(spark, d):
    return event_metrics(spark, d).groupBy("symbol").agg(F.count("*").alias("events"), F.round(F.avg(F.when(F.col("surprise") > 0, F.col("drift_20"))), 10).alias("drift_beat"), F.round(F.avg(F.when(F.col("surprise") < 0, F.col("drift_20"))), 10).alias("drift_miss"))


@query("a17_own_history", sql("r", ctes=ALL_EM, body="SELECT symbol, surprise > 0 AS beat, count(reaction) AS n, round(median(reaction), 8) AS median_reaction, round(avg(reaction), 6) AS mean_reaction, count(*) FILTER (reaction > 0) AS positive, CASE WHEN count(reaction) < 3 THEN 'limited' ELSE 'ok' END AS state FROM em WHERE surprise IS NOT NULL GROUP BY ALL"))
def a17(spark, d):
    g = event_metrics(spark, d).where("surprise IS NOT NULL").groupBy("symbol", (F.col("surprise") > 0).alias("beat"))
    return g.agg(F.count("reaction").alias("n"), F.round(F.percentile("reaction", 0.5), 8).alias("median_reaction"), F.round(F.avg("reaction"), 6).alias("mean_reaction"), F.count_if(F.col("reaction") > 0).alias("positive")).withColumn("state", F.when(F.col("n") < 3, "limited").otherwise("ok"))


@query("a18_surprise_buckets", sql("r", ctes=ALL_EM + ", k AS (SELECT *, floor((row_number() OVER (ORDER BY surprise, symbol, date) - 1) * 5 / count(*) OVER ())::INT + 1 AS bucket FROM em WHERE surprise IS NOT NULL)", body="SELECT bucket, count(*) AS n, round(avg(surprise), 6) AS mean_surprise, round(avg(reaction), 6) AS mean_reaction, round(avg(drift_20), 6) AS mean_drift FROM k GROUP BY bucket"))
def a18(spark, d):
    e = ranks.numbered(event_metrics(spark, d).where("surprise IS NOT NULL"), "surprise", "symbol", "date", out="k")
    n = e.groupBy().agg(F.count("*").alias("n"))
    e = e.withColumn("bucket", (F.floor((F.col("k") - 1) * 5 / n.scalar()) + 1).cast("int"))
    return e.groupBy("bucket").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(k) for c, k in (("surprise", "mean_surprise"), ("reaction", "mean_reaction"), ("drift_20", "mean_drift"))])


@query("a36_earnings_moves", sql("r", ctes=ALL_EM + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM em WHERE reaction IS NOT NULL)", body="SELECT symbol, count(*) AS n, round(avg(abs(reaction)), 6) AS mean_move, round(median(abs(reaction)), 8) AS median_move, round(median(abs(reaction)) FILTER (k <= 8), 8) AS median_last_8 FROM k GROUP BY symbol"))
def a36(spark, d):
    e = event_metrics(spark, d).where("reaction IS NOT NULL").withColumns({"m": F.abs("reaction"), "k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))})
    return e.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean_move"), F.round(F.percentile("m", 0.5), 8).alias("median_move"), F.round(F.percentile(F.when(F.col("k") <= 8, F.col("m")), 0.5), 8).alias("median_last_8"))


@query("r17_f23_drift_screen", sql("r", ctes=ALL_EM + ", l AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), z AS (SELECT l.symbol, count(*) FILTER (r.trade_date > l.trade_date) AS since FROM l LEFT JOIN r ON r.symbol = l.symbol GROUP BY l.symbol), u AS (SELECT symbol, min(date) AS upcoming FROM earn2 WHERE upcoming GROUP BY symbol)", body="SELECT symbol, date, surprise, reaction, since AS sessions_since, 20 - since AS remaining, u.upcoming, row_number() OVER (ORDER BY 20 - since DESC, abs(surprise) DESC, symbol) AS place FROM l JOIN z USING (symbol) LEFT JOIN u USING (symbol) WHERE since <= 20 AND surprise IS NOT NULL AND trade_date IS NOT NULL"))
def r17(spark, d):
    e = event_metrics(spark, d)
    latest = e.groupBy("symbol").agg(F.max_by(F.struct("date", "surprise", "reaction", "trade_date"), "date").alias("x")).select("symbol", "x.*")
    since = bars(spark, d).select("symbol", F.col("trade_date").alias("t")).join(latest, "symbol").groupBy("symbol", "date", "surprise", "reaction", "trade_date").agg(F.count_if(F.col("t") > F.col("trade_date")).alias("sessions_since"))
    due = earnings(spark, d).where("upcoming").groupBy("symbol").agg(F.min("date").alias("upcoming"))
    rows = since.where("sessions_since <= 20 AND surprise IS NOT NULL AND trade_date IS NOT NULL").withColumn("remaining", 20 - F.col("sessions_since")).join(due, "symbol", "left")
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("remaining"), F.desc(F.abs("surprise")), "symbol")  # a row a symbol with an open window
    return rows.select("symbol", "date", "surprise", "reaction", "sessions_since", "remaining", "upcoming", F.row_number().over(w).alias("place"))


@query("r20_src11_largest_prints", sql("prints", body="SELECT user_id, event_id, round(value * size, 4) AS premium, row_number() OVER (PARTITION BY user_id ORDER BY value * size DESC, event_id) AS place FROM prints WHERE value > 0 AND size > 0 QUALIFY place <= 3"))
def r20(spark, d):
    p = prints(spark, d).where("value > 0 AND size > 0").withColumn("x", F.col("value") * F.col("size"))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("x"), "event_id"))).where("place <= 3")
    return p.select("user_id", "event_id", F.round("x", 4).alias("premium"), "place")


@query("pf29_a19_net_activity", sql("prints", ctes="s AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN 0 ELSE -1 END AS sign FROM prints)", body="SELECT user_id, count(*) FILTER (sign = 1) AS buys, count(*) FILTER (sign = -1) AS sells, coalesce(sum(sign * size), 0)::BIGINT AS net, count(DISTINCT event_type) AS kinds FROM s GROUP BY user_id"))
def pf29(spark, d):
    s = prints(spark, d).withColumn("sign", F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", 0).otherwise(-1))
    return s.groupBy("user_id").agg(F.count_if(F.col("sign") == 1).alias("buys"), F.count_if(F.col("sign") == -1).alias("sells"), F.coalesce(F.sum(F.col("sign") * F.col("size")), F.lit(0)).alias("net"), F.count_distinct("event_type").alias("kinds"))


@query("a20_monthly_net", sql("prints", body="SELECT user_id, date_trunc('month', ts)::DATE AS month, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN size ELSE -size END)::BIGINT AS net FROM prints WHERE event_type <> 'error' GROUP BY ALL HAVING net <> 0"))
def a20(spark, d):
    p = prints(spark, d).where("event_type <> 'error'")
    signed = F.when(F.col("event_type").isin("purchase", "signup"), F.col("size")).otherwise(-F.col("size"))
    return p.groupBy("user_id", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.sum(signed).alias("net")).where("net <> 0")


@query("w28_level_touches", sql("r", ctes=f"t AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS lv, lead(ret) OVER {W} AS nx FROM r)", body="SELECT symbol, count(*) AS touches, count(*) FILTER (close < lv) AS reversals, round(avg(nx), 6) AS next_ret FROM t WHERE prev_close < lv AND high >= lv * 0.998 GROUP BY symbol"))
def w28(spark, d):
    """Touches of the 63-day high from below, how many closed under it, and the next day."""
    r = with_returns(bars(spark, d)).withColumns({"lv": F.max("high").over(R.before(63)), "nx": F.lead("ret").over(by_symbol())})
    t = r.where((F.col("prev_close") < F.col("lv")) & (F.col("high") >= F.col("lv") * 0.998))
    return t.groupBy("symbol").agg(F.count("*").alias("touches"), F.count_if(F.col("close") < F.col("lv")).alias("reversals"), F.round(F.avg("nx"), 6).alias("next_ret"))


NULLS = 25
TOUCHED = "nc IS NOT NULL AND prev_close < {0} AND high >= {0} * 0.998"
TOUCH_SQL = f"""t AS (SELECT symbol, high, close, prev_close, lead(close) OVER {W} AS nc, max(high) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS lv FROM r),
b AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM r GROUP BY symbol),
z0 AS (SELECT symbol, i, lo * 1.05::DOUBLE + ('0x' || substr(md5(symbol || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (hi * 0.95::DOUBLE - lo * 1.05::DOUBLE) AS level FROM b, range({NULLS}) g(i)),
q AS (SELECT symbol, i, count(*) FILTER (nc < close) / count(*) AS rate FROM t JOIN z0 USING (symbol) WHERE {TOUCHED.format('level')} GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT symbol, avg(rate) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(rate) ELSE 0.08 END AS sd FROM q GROUP BY symbol),
o AS (SELECT symbol, count(*) AS touches, count(*) FILTER (nc < close) AS reversals FROM t WHERE {TOUCHED.format('lv')} GROUP BY symbol),
j AS (SELECT symbol, touches, reversals, reversals / touches AS rate, coalesce(m, 0.5) AS m, coalesce(sd, 0.08) AS sd FROM o LEFT JOIN m USING (symbol)),
k AS (SELECT *, CASE WHEN touches >= 3 AND sd > 1e-9 THEN (rate - m) / sd ELSE 0 END AS z FROM j)"""


@query("w28_touch_significance", sql("r", ctes=TOUCH_SQL, body=f"SELECT symbol, touches, reversals, round(rate, 6) AS rate, round(m, 6) AS baseline, round(sd, 6) AS spread, round(z, 6) AS z, round(1 - {cdf_sql('z')}, 6) AS p FROM k"))
def w28_significance(spark, d):
    """Touches of the 63-day high after which the next close is lower, against levels drawn
    by a hash between each symbol's lowest and highest close: mean and spread of their
    rates (of those touched three times or more), one-sided z. Every bar meets its symbol's
    25 levels; nothing else is multiplied."""
    r = with_returns(bars(spark, d))
    t = r.select("symbol", "high", "close", "prev_close", F.lead("close").over(by_symbol()).alias("nc"), F.max("high").over(R.before(63)).alias("lv"))
    ends = r.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(NULLS - 1))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "symbol", "i").cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    drawn = ends.select("symbol", "i", (F.col("lo") * 1.05 + draw * (F.col("hi") * 0.95 - F.col("lo") * 1.05)).alias("level"))
    q = t.join(drawn, "symbol").where(TOUCHED.format("level")).groupBy("symbol", "i").agg(F.count("*").alias("n"), F.count_if(F.col("nc") < F.col("close")).alias("k")).where("n >= 3").withColumn("rate", F.col("k") / F.col("n"))
    m = q.groupBy("symbol").agg(F.avg("rate").alias("m"), F.when(F.count("*") > 1, F.stddev_pop("rate")).otherwise(0.08).alias("sd"))
    o = t.where(TOUCHED.format("lv")).groupBy("symbol").agg(F.count("*").alias("touches"), F.count_if(F.col("nc") < F.col("close")).alias("reversals")).join(m, "symbol", "left")
    o = o.withColumns({"rate": F.col("reversals") / F.col("touches"), "m": F.coalesce("m", F.lit(0.5)), "sd": F.coalesce("sd", F.lit(0.08))})
    o = o.withColumn("z", F.when((F.col("touches") >= 3) & (F.col("sd") > 1e-9), F.try_divide(F.col("rate") - F.col("m"), "sd")).otherwise(0.0))
    return R.tidy(o, "symbol", "touches", "reversals", rate=F.col("rate"), baseline=F.col("m"), spread=F.col("sd"), z=F.col("z"), p=1 - cdf(F.col("z")))
