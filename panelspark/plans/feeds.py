"""Registered queries: provider payloads. Payloads are built from the given tables, as a
provider would send them, and taken apart again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import rolling as R
from panelspark.plans.joins import MACRO, macro
from panelspark.registry import query
from panelspark.sources import feeds
from panelspark.sources.views import actions, bars, bench, bench_returns, chain, fundamentals, read, sql, with_returns


@query("src4_csv_members", "SELECT s_suppkey, upper(replace(trim(s_name), '#', '-')) AS symbol, n_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def src4_csv(spark, d):
    """Member lists as delimited text, one with another header: columns by their aliases."""
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.withColumn("header", F.when(F.col("s_suppkey") % 2 == 0, "Symbol,GICS Sector").otherwise("Sector,Ticker symbol"))
    s = s.withColumn("line", F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws(",", "s_name", "n_name")).otherwise(F.concat_ws(",", "n_name", "s_name")))
    cells = F.map_from_arrays(F.split("header", ","), F.split("line", ","))
    pick = lambda *names: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names])
    s = s.withColumn("cells", cells)
    return s.select("s_suppkey", F.upper(F.regexp_replace(F.trim(pick("Symbol", "Ticker symbol")), "#", "-")).alias("symbol"), pick("GICS Sector", "Sector").alias("sector"))


@query("src5_index_list", "WITH l AS (SELECT s_nationkey AS nation, s_suppkey // 100 AS page, upper(trim(s_name)) AS symbol, trim(regexp_replace(s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Common Stock' ELSE '' END, '\\s+Common Stock$', '')) AS name, n_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT *, count(*) OVER (PARTITION BY nation, page)::INT AS size, count(*) OVER (PARTITION BY nation, page) BETWEEN 1 AND 110 AS plausible FROM l")
def src5(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " Common Stock").otherwise(""))
    row = F.struct(F.col("s_name").alias("symbol"), name.alias("companyName"), F.concat(F.lit(" "), "n_name").alias("sector"))
    lists = s.groupBy(F.col("s_nationkey").alias("nation"), F.expr("s_suppkey div 100").alias("page")).agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(row).alias("rows")).alias("data")).alias("data"))).alias("payload"))
    return feeds.index_members(lists, "payload", (1, 110))


@query("src6_factor_texts", sql("br", body="SELECT trade_date AS date, round(round(bench_ret * 100, 4) / 100, 6) AS mkt, round(round(bench_ret * bench_ret * 100, 4) / 100, 6) AS sq, round(round(-bench_ret * 100, 4) / 100, 6) AS mom FROM br WHERE bench_ret IS NOT NULL AND day(trade_date) <> 13"))
def src6(spark, d):
    """Two factor texts with a preamble and yearly rows after the daily ones, joined by date."""
    b = bench_returns(bench(spark, d)).where("bench_ret IS NOT NULL")
    cell = lambda x: F.round(x * 100, 4).cast("decimal(24,4)").cast("string")
    day, x = F.date_format("trade_date", "yyyyMMdd"), F.col("bench_ret")
    year = b.select(F.concat_ws("  ", F.date_format("trade_date", "yyyy"), F.lit("1.00"), F.lit("2.00")).alias("line")).distinct()
    five = b.select(F.concat_ws("   ", day, cell(x), cell(x * x)).alias("line")).unionByName(year)
    mom = b.where(F.dayofmonth("trade_date") != 13).select(F.concat_ws(",", day, cell(-x)).alias("line")).unionByName(year)
    both = feeds.factor_rows(five, "line", ["mkt", "sq"]).join(feeds.factor_rows(mom, "line", ["mom"]), "date")
    return R.tidy(both, "date", mkt=F.col("mkt"), sq=F.col("sq"), mom=F.col("mom"))


@query("src7_macro_observations", sql("bench", ctes=MACRO, body="SELECT obs_date AS date, round(v, 4) AS value FROM macro WHERE month(obs_date) NOT IN (5, 7)"))
def src7(spark, d):
    m = macro(spark, d)
    value = F.when(F.month("obs_date") == 5, ".").when(F.month("obs_date") == 7, "").otherwise(F.round("v", 4).cast("decimal(20,4)").cast("string"))
    payloads = m.groupBy(F.year("obs_date").alias("y")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("obs_date").cast("string").alias("date"), value.alias("value"))).alias("observations"))).alias("payload"))
    return feeds.observations(payloads, "payload").withColumn("value", F.round("value", 4))


CODES = ("1.01", "2.02", "4.02", "5.07", "9.99", "7.01", "5.02")
FILED = f"codes AS (SELECT {list(CODES)} AS c), fl0 AS (SELECT o_custkey AS customer, o_orderkey::VARCHAR AS accession, CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'O' THEN '10-Q' ELSE '8-K/A' END AS form, o_orderdate::DATE AS filed, c[o_orderkey % 7 + 1] AS c1, c[o_orderkey // 7 % 7 + 1] AS c2 FROM orders, codes), fl1 AS (SELECT * FROM fl0 WHERE form <> '10-Q' QUALIFY row_number() OVER (PARTITION BY customer ORDER BY filed DESC, accession DESC) <= 20), fl AS (SELECT *, list_filter(CASE WHEN c1 = c2 THEN [c1] ELSE [c1, c2] END, lambda x: x <> '9.99') AS found FROM fl1)"
TYPED = "CASE " + " ".join(f"WHEN len(list_filter(found, lambda x: x IN ({', '.join(repr(c) for c, t in feeds.ITEM_TYPES.items() if t == kind)}))) > 0 THEN '{kind}'" for kind in feeds.TYPE_ORDER) + " END"


def filings(spark, d):
    """Each customer's orders as a feed of parallel arrays, a page a thousand orders."""
    o, codes = read(spark, d, "orders"), F.array(*map(F.lit, CODES))
    items = F.concat(F.get(codes, (F.col("o_orderkey") % 7).cast("int")), F.lit(",9.99; "), F.get(codes, F.expr("o_orderkey div 7 % 7").cast("int")))
    row = F.struct(F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K/A").alias("form"), F.to_date("o_orderdate").cast("string").alias("filingDate"), F.col("o_orderkey").cast("string").alias("accessionNumber"), items.alias("items"))
    per = o.groupBy(F.col("o_custkey").alias("customer"), F.expr("o_orderkey div 1000").alias("page")).agg(F.collect_list(row).alias("r"))
    recent = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "items")])
    return feeds.filings(per.select("customer", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("payload")), "payload", "customer")


@query("src8_filing_feed", f"WITH {FILED} SELECT customer, accession, form, filed FROM fl")
def src8(spark, d):
    return filings(spark, d).select("customer", "accession", "form", "filed")


@query("pf20_pf21_pf22_filing_events", f"WITH {FILED} SELECT customer, accession, array_to_string(found, ',') AS items, len(list_filter(found, lambda x: x IN {feeds.HIGH_IMPACT})) > 0 AS high_impact, {TYPED} AS event_type FROM fl")
def pf21(spark, d):
    """Known item codes split from the feed's text, impact by overlap, type by priority."""
    return filings(spark, d).select("customer", "accession", "items", "high_impact", "event_type")


@query("src9_nested_chain", sql("chain", body="SELECT underlying, dte, cp, contract, strike, round(iv, 6) AS iv, oi FROM chain QUALIFY dense_rank() OVER (PARTITION BY underlying ORDER BY dte) <= 5"))
def src9(spark, d):
    """Chains nested by expiry and side, a page ten thousand contracts, to one row each."""
    row = F.struct("contract", "strike", F.round("iv", 6).alias("iv"), "oi")
    side = lambda cp: F.collect_list(F.when(F.col("cp") == cp, row))
    per = chain(spark, d).groupBy("underlying", F.expr("contract div 10000").alias("page"), "dte").agg(side("C").alias("calls"), side("P").alias("puts"))
    pages = per.groupBy("underlying", "page").agg(F.to_json(F.struct(F.collect_list(F.struct("dte", "calls", "puts")).alias("options"))).alias("payload"))
    return feeds.long_chain(pages, "payload", "underlying", 5)


SHORT = "z AS (SELECT *, max(trade_date) OVER (PARTITION BY symbol) AS t FROM bars), si AS (SELECT symbol, sum(volume) FILTER (trade_date > t - 90)::DOUBLE AS cur, sum(volume) FILTER (trade_date > t - 180 AND trade_date <= t - 90)::DOUBLE AS prior, sum(volume)::DOUBLE AS total, avg(volume) AS day FROM z GROUP BY symbol)"


def short_interest(spark, d):
    """Each symbol's short-interest payload: here the volume of its last 90 days, that of the
    90 before, against all volume and a mean day."""
    z = bars(spark, d).withColumn("t", F.max("trade_date").over(Window.partitionBy("symbol")))
    back = F.datediff("t", "trade_date")
    g = z.groupBy("symbol").agg(F.sum(F.when(back < 90, F.col("volume"))).cast("double").alias("sharesShort"), F.sum(F.when((back >= 90) & (back < 180), F.col("volume"))).cast("double").alias("sharesShortPriorMonth"), F.sum("volume").cast("double").alias("total"), F.avg("volume").alias("day"))
    g = g.withColumns({"shortPercentOfFloat": F.round(100 * F.col("sharesShort") / F.col("total"), 6), "shortRatio": F.round(F.col("sharesShort") / F.col("day") / 10, 6)})
    return feeds.short_interest(g.select("symbol", F.to_json(F.struct("sharesShort", "sharesShortPriorMonth", "shortPercentOfFloat", "shortRatio")).alias("payload")), "payload", "symbol")


@query("src14_short_interest", sql("bars", ctes=SHORT, body="SELECT symbol, cur AS shares_short, round(100 * cur / total, 6) AS pct_float, round(cur / day / 10, 6) AS days_to_cover, round((cur - prior) / nullif(prior, 0), 4) AS change FROM si WHERE cur IS NOT NULL"))
def src14(spark, d):
    return short_interest(spark, d)


@query("r18_short_squeeze", sql("bars", ctes=SHORT + ", s AS (SELECT symbol, round(100 * cur / total, 6) AS pct, round(cur / day / 10, 6) AS dtc FROM si WHERE cur IS NOT NULL)", body="SELECT symbol, pct AS pct_float, dtc AS days_to_cover, round(100 * (least(greatest(pct, 0) / 25, 1) * 40 + least(greatest(dtc, 0) / 7, 1) * 30 + 5) / 85, 6) AS score FROM s"))
def r18_short(spark, d):
    """Squeeze risk of the reported short interest: 40 points by share of the float, 30 by days
    to cover, 5 of 15 where dealers' gamma isn't known to be negative, of 85 in all."""
    unit = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)) / top, F.lit(1.0))
    return short_interest(spark, d).select("symbol", "pct_float", "days_to_cover", F.round(100 * (unit("pct_float", 25) * 40 + unit("days_to_cover", 7) * 30 + 5) / 85, 6).alias("score"))


@query("src15_first_feed", sql("actions", ctes="f AS (SELECT entity_id, action_id, CASE status WHEN 'P' THEN 1 WHEN 'O' THEN 2 END AS feed FROM actions WHERE status IN ('P', 'O'))", body="SELECT * FROM f QUALIFY feed = min(feed) OVER (PARTITION BY entity_id)"))
def src15(spark, d):
    a = actions(spark, d)
    one = lambda s: a.where(F.col("status") == s).select("entity_id", "action_id")
    return feeds.first_feed([one("P"), one("O")], "entity_id")


METRIC_KEYS = {"pe": ("peTTM", "peAnnual"), "beta": ("beta", "beta5y"), "debt": ("debtAnnual",)}


@query("src16_first_of_keys", "WITH f AS (SELECT c_custkey AS company, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 2) ELSE c_nationkey END AS pe, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey + 0.5 END AS beta FROM customer) SELECT company, 'pe' AS label, pe::DOUBLE AS value FROM f UNION ALL SELECT company, 'beta', beta::DOUBLE FROM f WHERE beta IS NOT NULL")
def src16(spark, d):
    """The first of the candidate keys of each metric that a payload has; rows a metric."""
    c = read(spark, d, "customer")
    nation = F.col("c_nationkey")
    payload = F.to_json(F.struct(F.when(F.col("c_acctbal") > 0, F.round("c_acctbal", 2)).alias("peTTM"), nation.alias("peAnnual"), F.when(nation % 3 == 0, nation + 0.5).alias("beta5y")))
    c = c.select(F.col("c_custkey").alias("company"), payload.alias("payload"))
    c = c.select("company", *[feeds.first_of("payload", *keys).cast("double").alias(k) for k, keys in METRIC_KEYS.items()])
    return c.unpivot("company", list(METRIC_KEYS), "label", "value").where("value IS NOT NULL")


@query("a45_extracts", sql("actions", ctes="t AS (SELECT max(effective_date) AS t FROM actions)", body="SELECT 'latest' AS kind, action_type, action_id, amount FROM (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY action_type ORDER BY effective_date DESC, action_id DESC) = 1) UNION ALL SELECT 'top', action_type, action_id, amount FROM (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY action_type ORDER BY amount DESC, action_id) <= 10) UNION ALL SELECT 'recent', action_type, action_id, amount FROM actions, t WHERE effective_date >= (t - INTERVAL 18 MONTH)::DATE"))
def a45(spark, d):
    """The latest row of each type, its ten largest, and the last 18 months."""
    a = actions(spark, d)
    out = ("action_type", "action_id", "amount")
    latest = a.groupBy("action_type").agg(F.max_by(F.struct("action_id", "amount"), F.struct("effective_date", "action_id")).alias("x")).select("action_type", "x.*")
    top = a.withColumn("k", F.row_number().over(Window.partitionBy("action_type").orderBy(F.desc("amount"), "action_id"))).where("k <= 10")
    recent = a.where(F.col("effective_date") >= F.add_months(a.agg(F.max("effective_date")).scalar(), -18))
    parts = [p.select(F.lit(kind).alias("kind"), *out) for kind, p in (("latest", latest), ("top", top), ("recent", recent))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f21_risk_free_rate", sql("bench", ctes=MACRO + ", q AS (SELECT obs_date, v / 1000 - 1 AS a, v / 400 AS b FROM macro)", body="SELECT obs_date, round(CASE WHEN a BETWEEN 0 AND 25 THEN a WHEN b BETWEEN 0 AND 25 THEN b ELSE 4.5 END / 100, 6) AS rate, CASE WHEN a BETWEEN 0 AND 25 THEN 'bill' WHEN b BETWEEN 0 AND 25 THEN 'funds' ELSE 'fallback' END AS source FROM q"))
def f21(spark, d):
    q = macro(spark, d).select("obs_date", (F.col("v") / 1000 - 1).alias("a"), (F.col("v") / 400).alias("b"))
    rate, label = feeds.risk_free(F.col("a"), F.col("b"))
    return q.select("obs_date", F.round(rate, 6).alias("rate"), label.alias("source"))


@query("f22_target_upside", sql("fundamentals", ctes="t AS (SELECT *, avg(multiple) OVER (PARTITION BY industry) AS target FROM fundamentals WHERE multiple > 0)", body="SELECT company, round(100 * (target / multiple - 1), 6) AS upside_pct, round(target - multiple, 6) AS distance FROM t"))
def f22(spark, d):
    """Distance to the mean target, here the industry's mean multiple."""
    t = fundamentals(spark, d).where("multiple > 0").withColumn("target", F.avg("multiple").over(Window.partitionBy("industry")))
    return R.tidy(t, "company", upside_pct=100 * (F.col("target") / F.col("multiple") - 1), distance=F.col("target") - F.col("multiple"))


@query("f17_position_scaling", sql("r", ctes="q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q FROM r GROUP BY symbol), e AS (SELECT symbol, q, avg(ret) AS es FROM r JOIN q USING (symbol) WHERE ret <= q GROUP BY symbol, q)", body="SELECT symbol, 1000000.0::DOUBLE AS position, round(q * 1000000, 2) AS var_money, round(es * 1000000, 2) AS es_money FROM e"))
def f17(spark, d):
    """Value at risk and shortfall of a position of a million, in money."""
    r = with_returns(bars(spark, d))
    q = r.groupBy("symbol").agg(F.percentile("ret", 0.05).alias("q"))
    e = r.join(q, "symbol").where("ret <= q").groupBy("symbol", "q").agg(F.avg("ret").alias("es"))
    return e.select("symbol", F.lit(1e6).alias("position"), F.round(F.col("q") * 1e6, 2).alias("var_money"), F.round(F.col("es") * 1e6, 2).alias("es_money"))
