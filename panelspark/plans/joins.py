"""Registered queries: point-in-time, interval, set and dimension joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import rolling as R
from panelspark.operators.asof import asof, nearest
from panelspark.registry import query
from panelspark.sources.views import CUSTOMER, actions, bars, bench, by_symbol, customer_symbol, read, sectors, sql, timeline, with_returns

EVENTS = f"ev AS (SELECT {CUSTOMER} AS symbol, o_orderpriority AS event_type, o_orderdate::DATE AS event_date, o_orderstatus = 'F' AS after_close, NULL::DATE AS end_date FROM orders)"


def events(spark, d):
    """(symbol, event_type, event_date, after_close, end_date)."""
    return read(spark, d, "orders").select(customer_symbol(spark, d, "o_custkey").alias("symbol"), F.col("o_orderpriority").alias("event_type"), F.to_date("o_orderdate").alias("event_date"), (F.col("o_orderstatus") == "F").alias("after_close"), F.lit(None).cast("date").alias("end_date"))


@query("j4_entity_lineage", sql("timeline", body="SELECT c_custkey AS entity_id, c_name AS name, t.action_id, t.valid_from, t.valid_to, a.action_type, a.status FROM customer LEFT JOIN timeline t ON t.entity_id = c_custkey LEFT JOIN actions a ON a.action_id = t.action_id AND a.entity_id = t.entity_id"))
def j4(spark, d):
    a = actions(spark, d)
    t = timeline(a).select("entity_id", "action_id", "valid_from", "valid_to")
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return names.join(t, "entity_id", "left").join(a.select("entity_id", "action_id", "action_type", "status"), ["entity_id", "action_id"], "left").select("entity_id", "name", "action_id", "valid_from", "valid_to", "action_type", "status")


@query("j5_point_in_time", sql("timeline", ctes="ask AS (SELECT DISTINCT entity_id, (date_trunc('year', effective_date) + INTERVAL 6 MONTH)::DATE AS as_of FROM actions)", body="SELECT entity_id, as_of, action_id, valid_from FROM ask JOIN timeline USING (entity_id) WHERE valid_from <= as_of AND valid_to >= as_of QUALIFY row_number() OVER (PARTITION BY entity_id, as_of ORDER BY valid_from DESC, action_id DESC) = 1"))
def j5(spark, d):
    """Which action of an entity held in the middle of each year with one: the entity is
    the equi key, the interval a residual."""
    a = actions(spark, d)
    ask = a.select("entity_id", F.add_months(F.trunc("effective_date", "year"), 6).alias("as_of")).distinct()
    held = ask.join(timeline(a), "entity_id").where("valid_from <= as_of AND valid_to >= as_of")
    first = F.row_number().over(Window.partitionBy("entity_id", "as_of").orderBy(F.desc("valid_from"), F.desc("action_id")))
    return held.withColumn("k", first).where("k = 1").select("entity_id", "as_of", "action_id", "valid_from")


MACRO = "macro AS (SELECT max(trade_date) AS obs_date, arg_max(close, trade_date) AS v FROM bench GROUP BY date_trunc('month', trade_date))"


def macro(spark, d):
    """(obs_date, v): the benchmark's last close of each month."""
    return bench(spark, d).groupBy(F.trunc("trade_date", "month").alias("m")).agg(F.max("trade_date").alias("obs_date"), F.max_by("close", "trade_date").alias("v")).drop("m")


@query("j6_forward_fill", sql("bars", "bench", ctes=MACRO, body="SELECT symbol, trade_date, round(v, 6) AS macro FROM bars ASOF LEFT JOIN macro ON trade_date >= obs_date"))
def j6(spark, d):
    # the macro series is one key: dates are filled once, then joined to all symbols
    b = bars(spark, d)
    dates = asof(b.select("trade_date").distinct().withColumn("one", F.lit(1)), "trade_date", macro(spark, d).withColumn("one", F.lit(1)), "obs_date", ["one"], ["v"])
    return b.join(dates, "trade_date").select("symbol", "trade_date", F.round("v", 6).alias("macro"))


@query("w36_macro_change", sql("bench", ctes=MACRO + ", f AS (SELECT trade_date, v FROM bench ASOF LEFT JOIN macro ON trade_date >= obs_date)", body="SELECT trade_date, round(v - lag(v, 63) OVER (ORDER BY trade_date), 6) AS change_63 FROM f"))
def w36(spark, d):
    f = asof(bench(spark, d).select("trade_date").withColumn("one", F.lit(1)), "trade_date", macro(spark, d).withColumn("one", F.lit(1)), "obs_date", ["one"], ["v"])
    return f.select("trade_date", F.round(F.col("v") - F.lag("v", 63).over(Window.partitionBy("one").orderBy("trade_date")), 6).alias("change_63"))


@query("w39_yearly_change", sql("bench", ctes=MACRO, body="SELECT obs_date, round(v / lag(v, 12) OVER (ORDER BY obs_date) - 1, 6) AS yoy FROM macro"))
def w39(spark, d):
    return macro(spark, d).select("obs_date", F.round(F.col("v") / F.lag("v", 12).over(Window.partitionBy(F.lit(1)).orderBy("obs_date")) - 1, 6).alias("yoy"))


@query("j7_reaction_session", sql("bars", ctes=EVENTS + ", e AS (SELECT DISTINCT symbol, event_date FROM ev)", body="SELECT e.symbol, event_date, trade_date AS reaction FROM e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND event_date <= trade_date"))
def j7(spark, d):
    e = events(spark, d).select("symbol", "event_date").distinct()
    return asof(e, "event_date", bars(spark, d).select("symbol", "trade_date"), "trade_date", ["symbol"], ["trade_date"], forward=True).withColumnRenamed("trade_date", "reaction")


@query("j8_event_session", sql("bars", ctes=EVENTS + ", e AS (SELECT DISTINCT symbol, event_date, after_close FROM ev)", body="SELECT e.symbol, event_date, after_close, trade_date AS session FROM (SELECT * FROM e WHERE after_close) e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND event_date < trade_date UNION ALL SELECT e.symbol, event_date, after_close, trade_date FROM (SELECT * FROM e WHERE NOT after_close) e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND event_date >= trade_date"))
def j8(spark, d):
    e = events(spark, d).select("symbol", "event_date", "after_close").distinct()
    b = bars(spark, d).select("symbol", "trade_date")
    late = asof(e.where("after_close"), "event_date", b, "trade_date", ["symbol"], ["trade_date"], forward=True, strict=True)
    return late.unionByName(asof(e.where("NOT after_close"), "event_date", b, "trade_date", ["symbol"], ["trade_date"])).withColumnRenamed("trade_date", "session")


@query("j9_w7_nearest_price", sql("bars", ctes="t AS (SELECT symbol, trade_date, (trade_date - INTERVAL 12 MONTH)::DATE AS target, close FROM bars), n AS (SELECT t.symbol, t.trade_date, t.target, t.close, b.trade_date AS bd, b.close AS bc FROM t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.target >= b.trade_date), m AS (SELECT n.*, f.trade_date AS fd, f.close AS fc FROM n ASOF LEFT JOIN bars f ON n.symbol = f.symbol AND n.target <= f.trade_date), p AS (SELECT *, target - bd AS d1, fd - target AS d2 FROM m)", body="SELECT symbol, trade_date, CASE WHEN d1 IS NOT NULL AND (d2 IS NULL OR d1 <= d2) THEN CASE WHEN d1 <= 14 THEN d1 END WHEN d2 <= 14 THEN d2 END AS gap, round(close / CASE WHEN d1 IS NOT NULL AND (d2 IS NULL OR d1 <= d2) THEN CASE WHEN d1 <= 14 THEN bc END WHEN d2 <= 14 THEN fc END - 1, 6) AS change_1y FROM p"))
def j9(spark, d):
    b = bars(spark, d)
    left = b.select("symbol", "trade_date", F.add_months("trade_date", -12).alias("target"), F.col("close").alias("now"))
    n = nearest(left, "target", b.select("symbol", F.col("trade_date").alias("d"), "close"), "d", ["symbol"], "close", 14)
    return n.select("symbol", "trade_date", F.col("gap").cast("bigint").alias("gap"), F.round(F.col("now") / F.col("close") - 1, 6).alias("change_1y"))


@query("j11_sector_members", sql("bars", "sectors", body="SELECT coalesce(sector, 'Other') AS sector, count(DISTINCT b.symbol) AS symbols, count(*) AS bars FROM bars b LEFT JOIN sectors s ON s.symbol = b.symbol GROUP BY 1"))
def j11(spark, d):
    per = bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n")).join(sectors(spark, d), "symbol", "left")
    return per.groupBy(F.coalesce("sector", F.lit("Other")).alias("sector")).agg(F.count("*").alias("symbols"), F.sum("n").alias("bars"))


@query("j14_u3_uncovered", sql("bars", "sectors", body="SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN (SELECT symbol FROM sectors WHERE sector = 'ASIA')"))
def j14(spark, d):
    return bars(spark, d).select("symbol").distinct().join(sectors(spark, d).where("sector = 'ASIA'"), "symbol", "left_anti")


@query("j22_split_adjusted", sql("bars", ctes="sp AS (SELECT symbol, trade_date AS eff, 1.0 + (volume % 4) AS ratio FROM bars WHERE day(trade_date) = 1 AND month(trade_date) = 1 AND volume % 4 > 0), l AS (SELECT symbol, eff, sum(ln(ratio)) AS lr FROM sp GROUP BY ALL), u AS (SELECT symbol, trade_date, close, volume, 1 AS side, 0.0 AS lr FROM bars UNION ALL SELECT symbol, eff, NULL, NULL, 0, lr FROM l), a AS (SELECT *, sum(lr) OVER (PARTITION BY symbol ORDER BY trade_date DESC, side DESC ROWS UNBOUNDED PRECEDING) AS s FROM u)", body="SELECT symbol, trade_date, round(close / exp(s), 9) AS close, floor(round(volume * exp(s), 6))::BIGINT AS volume FROM a WHERE side = 1"))
def j22(spark, d):
    """Splits here: New Year's bars, ratio by volume. Prices are divided, and volumes
    multiplied, by the ratios of all later splits: a running sum of logarithms."""
    b = bars(spark, d)
    splits = b.where((F.dayofmonth("trade_date") == 1) & (F.month("trade_date") == 1) & (F.col("volume") % 4 > 0)).select("symbol", "trade_date", F.ln(1.0 + F.col("volume") % 4).alias("lr"))
    both = b.select("symbol", "trade_date", "close", "volume", F.lit(1).alias("side"), F.lit(0.0).alias("lr")).unionByName(splits.withColumn("side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("s", F.sum("lr").over(w)).where("side = 1")
    return both.select("symbol", "trade_date", F.round(F.col("close") / F.exp("s"), 9).alias("close"), F.floor(F.round(F.col("volume") * F.exp("s"), 6)).alias("volume"))


@query("j23_rebased_series", sql("bars", "bench", ctes="c AS (SELECT symbol, trade_date, b.close, n.close AS bc FROM bars b JOIN bench n USING (trade_date))", body="SELECT symbol, trade_date, round(100 * close / first_value(close) OVER w, 6) AS rebased, round(100 * bc / first_value(bc) OVER w, 6) AS bench_rebased FROM c WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"))
def j23(spark, d):
    c = bars(spark, d).join(bench(spark, d).select("trade_date", F.col("close").alias("bc")), "trade_date")
    return R.tidy(c, "symbol", "trade_date", rebased=100 * F.col("close") / F.first("close").over(by_symbol()), bench_rebased=100 * F.col("bc") / F.first("bc").over(by_symbol()))


@query("j25_reindexed_benchmark", sql("r", "br", body="SELECT symbol, trade_date, round(ret - coalesce(bench_ret, 0), 6) AS excess FROM r LEFT JOIN br USING (trade_date)"))
def j25(spark, d):
    from panelspark.sources.views import bench_returns

    r = with_returns(bars(spark, d)).join(bench_returns(bench(spark, d)), "trade_date", "left")
    return r.select("symbol", "trade_date", F.round(F.col("ret") - F.coalesce("bench_ret", F.lit(0.0)), 6).alias("excess"))


@query("j26_u1_index_members", sql("bars", "sectors", body="SELECT symbol, count(*) AS bars FROM bars WHERE symbol IN (SELECT symbol FROM sectors WHERE sector = 'EUROPE' UNION SELECT symbol FROM sectors WHERE sector = 'AMERICA') GROUP BY symbol"))
def j26(spark, d):
    s = sectors(spark, d)
    members = s.where("sector = 'EUROPE'").select("symbol").union(s.where("sector = 'AMERICA'").select("symbol")).distinct()
    return bars(spark, d).join(members, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("bars"))


@query("u2_tiered_universe", sql("bars", "sectors", body="SELECT symbol, min(tier) AS tier FROM (SELECT symbol, 1 AS tier FROM sectors WHERE sector = 'ASIA' UNION ALL SELECT symbol, 2 FROM sectors UNION ALL SELECT symbol, 3 FROM bars) GROUP BY symbol"))
def u2(spark, d):
    s = sectors(spark, d)
    parts = s.where("sector = 'ASIA'").select("symbol", F.lit(1).alias("tier")).unionByName(s.select("symbol", F.lit(2).alias("tier"))).unionByName(bars(spark, d).select("symbol", F.lit(3).alias("tier")))
    return parts.groupBy("symbol").agg(F.min("tier").alias("tier"))


@query("j20_peers", sql("fundamentals", ctes="f AS (SELECT *, count(*) OVER (PARTITION BY sector, industry) AS n FROM fundamentals), p AS (SELECT a.company, b.company AS peer, CASE WHEN a.n > 5 THEN 'industry' ELSE 'sector' END AS cohort, row_number() OVER (PARTITION BY a.company ORDER BY abs(a.multiple - b.multiple), b.company) AS k FROM f a JOIN f b ON a.sector = b.sector AND (a.n <= 5 OR a.industry = b.industry) AND a.company <> b.company)", body="SELECT company, peer, cohort, k AS place FROM p WHERE k <= 5"))
def j20(spark, d):
    """The five of the same sector and industry (of the sector, where an industry has fewer)
    whose multiple is nearest. Neighbours in a sorted group are enough, so no pair beyond
    ten places is made."""
    from panelspark.sources.views import fundamentals

    f, own = fundamentals(spark, d), ("sector", "industry")
    around = lambda *by: F.collect_list(F.struct(F.col("company").alias("peer"), F.col("multiple").alias("pm"))).over(Window.partitionBy(*by).orderBy("multiple", "company").rowsBetween(-10, 10))
    f = f.withColumns({"n": F.count("*").over(Window.partitionBy(*own)), "near1": around(*own), "near2": around("sector")})
    p = f.select("company", "multiple", F.when(F.col("n") > 5, "industry").otherwise("sector").alias("cohort"), F.when(F.col("n") > 5, F.col("near1")).otherwise(F.col("near2")).alias("near"))
    p = p.select("company", "multiple", "cohort", F.inline("near")).where("peer <> company")
    k = F.row_number().over(Window.partitionBy("company").orderBy(F.abs(F.col("multiple") - F.col("pm")), "peer"))
    return p.withColumn("place", k).where("place <= 5").select("company", "peer", "cohort", "place")


@query("j21_prior_snapshot", sql("bars", ctes="c AS (SELECT symbol, date_trunc('month', trade_date)::DATE AS m, max(trade_date) AS snap, arg_max(close, trade_date) AS v FROM bars GROUP BY ALL), p AS (SELECT a.symbol, a.snap, a.v, b.snap AS prior, b.v AS pv, row_number() OVER (PARTITION BY a.symbol, a.snap ORDER BY abs((a.snap - b.snap) - 90), b.snap) AS k FROM c a JOIN c b ON a.symbol = b.symbol AND a.snap - b.snap BETWEEN 45 AND 150)", body="SELECT symbol, snap, prior, round(v / pv - 1, 6) AS change FROM p WHERE k = 1"))
def j21(spark, d):
    c = bars(spark, d).groupBy("symbol", F.trunc("trade_date", "month").alias("m")).agg(F.max("trade_date").alias("snap"), F.max_by("close", "trade_date").alias("v"))
    # snapshots are monthly: the band of 45 to 150 days is 1 to 5 months back
    prior = c.select("symbol", F.col("m").alias("pm"), F.col("snap").alias("prior"), F.col("v").alias("pv"))
    p = c.withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("pm", F.add_months("m", -F.col("back"))).join(prior, ["symbol", "pm"])
    days = F.datediff("snap", "prior")
    p = p.where(days.between(45, 150)).withColumn("k", F.row_number().over(Window.partitionBy("symbol", "snap").orderBy(F.abs(days - 90), "prior")))
    return p.where("k = 1").select("symbol", "snap", "prior", F.round(F.col("v") / F.col("pv") - 1, 6).alias("change"))
