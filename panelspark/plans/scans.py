"""Registered queries: sources, payloads, freshness, snapshots, contracts, text cleaning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.registry import query
from panelspark.sources import payloads as P
from panelspark.sources.views import actions, bars, chain, prints, read, sql


@query("src1_src2_bar_scan", sql("bars", body="SELECT symbol, trade_date, round(close, 6) AS close, volume FROM bars"))
def src1(spark, d):
    return bars(spark, d).select("symbol", "trade_date", F.round("close", 6).alias("close"), "volume")


@query("src3_parametrised_sql", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def src3(spark, d):
    return spark.sql("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderdate >= :since AND array_contains(:states, o_orderstatus) GROUP BY 1", args={"since": "1995-01-01", "states": F.array(F.lit("F"), F.lit("O"))}, orders=read(spark, d, "orders"))


@query("src20_ohlcv_export", sql("bars", body="SELECT symbol, trade_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars WHERE trade_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'"))
def src20(spark, d):
    b = bars(spark, d).where(F.col("trade_date").between("1994-01-01", "1996-12-31"))
    one = F.row_number().over(Window.partitionBy("symbol", "trade_date").orderBy(F.desc("volume")))
    b = b.withColumn("k", one).where("k = 1 AND NOT isnan(close)")
    return b.select("symbol", "trade_date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("src13_f13_payload_fields", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, coalesce((props::JSON ->> 'missing')::BIGINT, (props::JSON ->> 'k')::BIGINT, -1) AS first_of FROM events")
def src13(spark, d):
    e = read(spark, d, "events").withColumn("p", F.from_json("props", "k BIGINT, missing BIGINT"))
    return e.select("event_id", F.col("p.k").alias("k"), F.coalesce("p.missing", "p.k", F.lit(-1)).alias("first_of"))


@query("src17_src19_payload_freshness", "SELECT event_type AS provider, count(*) AS payloads, max(ts) AS newest, min(ts) AS oldest FROM events WHERE event_type LIKE 'p%' GROUP BY 1")
def src17(spark, d):
    return P.freshness(P.by_prefix(P.snapshots(read(spark, d, "events")), "p"))


@query("src18_a34_latest_within_ttl", "WITH l AS (SELECT event_type AS provider, user_id AS key, max(ts) AS fetched_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) SELECT provider, key, event_id, date_sub('second', fetched_at, TIMESTAMP '2024-02-01')::BIGINT AS age FROM l WHERE fetched_at >= TIMESTAMP '2024-01-28'")
def src18(spark, d):
    s = P.latest(P.snapshots(read(spark, d, "events"))).where("fetched_at >= timestamp'2024-01-28'")
    return s.select("provider", "key", "event_id", F.timestamp_diff("SECOND", "fetched_at", F.lit("2024-02-01").cast("timestamp")).alias("age"))


@query("pf28_receipts", "WITH l AS (SELECT user_id AS key, max(ts) AS seen FROM events GROUP BY 1) SELECT c_custkey AS key, CASE WHEN seen IS NULL THEN 'unavailable' WHEN seen < TIMESTAMP '2024-01-25' THEN 'stale' ELSE 'live' END AS state FROM customer LEFT JOIN l ON key = c_custkey")
def pf28(spark, d):
    seen = read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("at"))
    return P.receipts(read(spark, d, "customer").select(F.col("c_custkey").alias("key")), seen, "2024-01-25")


@query("snk1_bar_upsert", sql("bars", ctes="n AS (SELECT symbol, trade_date, close * 2 AS close, volume, 1 AS g FROM bars WHERE year(trade_date) = 1998 UNION ALL SELECT symbol, trade_date, close, volume, 0 FROM bars)", body="SELECT symbol, trade_date, round(arg_max(close, g), 6) AS close, arg_max(volume, g) AS volume FROM n GROUP BY ALL"))
def snk1(spark, d):
    """New bars replace old ones by key; here a revision doubles the closes of 1998."""
    old = bars(spark, d).select("symbol", "trade_date", "close", "volume")
    new = old.where(F.year("trade_date") == 1998).withColumn("close", F.col("close") * 2)
    return P.upsert(old, new, ["symbol", "trade_date"]).select("symbol", "trade_date", F.round("close", 6).alias("close"), "volume")


@query("snk2_insert_or_ignore", sql("actions", body="SELECT entity_id, min(action_id) AS action_id, count(*) AS seen FROM actions GROUP BY entity_id"))
def snk2(spark, d):
    a = actions(spark, d)
    first = P.insert_new(a.limit(0).select("entity_id", "action_id"), a.select("entity_id", "action_id"), ["entity_id"], "action_id")
    return first.join(a.groupBy("entity_id").agg(F.count("*").alias("seen")), "entity_id")


@query("snk4_trial_ledger", sql("actions", body="SELECT action_type, greatest(1, count(*)) AS trials, max(effective_date) AS last FROM actions GROUP BY 1"))
def snk4(spark, d):
    return actions(spark, d).groupBy("action_type").agg(F.greatest(F.lit(1), F.count("*")).alias("trials"), F.max("effective_date").alias("last"))


@query("snk5_snk6_j13_published", "SELECT provider, snapshot_id, count(*) AS rows FROM (SELECT event_type AS provider, date_trunc('day', ts)::DATE AS snapshot_id, dense_rank() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) DESC) AS k FROM events) WHERE k <= 2 GROUP BY ALL")
def snk5(spark, d):
    """Two newest snapshots of each provider are kept; the pointer names the newest."""
    s = read(spark, d, "events").select(F.col("event_type").alias("provider"), F.to_date("ts").alias("snapshot_id"))
    kept = P.retained(s.select("provider", "snapshot_id").distinct(), 2)
    return s.join(kept, ["provider", "snapshot_id"]).groupBy("provider", "snapshot_id").agg(F.count("*").alias("rows"))


@query("pf27_contract_check", sql("bars", body="SELECT 'close' AS term, count(*) AS rows, count(*) FILTER (close IS NULL) AS missing, count(*) FILTER (close <= 0) AS broken FROM bars UNION ALL SELECT 'volume', count(*), count(*) FILTER (volume IS NULL), count(*) FILTER (volume < 0) FROM bars"))
def pf27(spark, d):
    return P.contract(bars(spark, d), {"close": F.col("close") <= 0, "volume": F.col("volume") < 0})


@query("f11_canonical_urls", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || substr(regexp_replace(url, '#.*$', ''), length(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) + 1), '([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '\?&+', '?'), '&&+', '&', 'g') AS canonical FROM pages")
def f11(spark, d):
    return read(spark, d, "pages").select("page_id", P.canonical(F.col("url")).alias("canonical"))


@query("a46_pf19_distinct_articles", r"WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || substr(regexp_replace(url, '#.*$', ''), length(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) + 1), '([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '\?&+', '?'), '&&+', '&', 'g') AS u FROM pages WHERE url IS NOT NULL AND html IS NOT NULL) SELECT u AS canonical, min(page_id) AS page_id, count(*) AS copies FROM c GROUP BY u")
def a46(spark, d):
    p = read(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL").select("page_id", P.canonical(F.col("url")).alias("canonical"))
    return p.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query("pf20_pf22_filing_items", "WITH f AS (SELECT event_id, list_distinct([(size % 9)::INT, (size // 9 % 9)::INT, (size // 81 % 9)::INT]) AS items FROM (SELECT event_id, (props::JSON ->> 'k')::BIGINT AS size FROM events)) SELECT event_id, len(list_filter(items, lambda i: i BETWEEN 1 AND 6)) AS known, len(list_filter(items, lambda i: i IN (1, 4))) > 0 AS high_impact, list_min(list_filter(items, lambda i: i BETWEEN 1 AND 6)) AS event_type FROM f")
def pf20(spark, d):
    """Item codes made from each print's size: known ones kept in order, impact by overlap,
    the type by the least (first in priority) code."""
    k = F.col("size")
    items = F.array_distinct(F.split(F.concat_ws(";", (k % 9).cast("string"), F.expr("size div 9 % 9").cast("string"), F.expr("size div 81 % 9").cast("string")), "[,;\\s]+"))
    p = prints(spark, d).withColumn("items", F.transform(items, lambda x: x.cast("int")))
    p = p.withColumn("known_items", F.filter("items", lambda x: x.between(1, 6)))
    return p.select("event_id", F.size("known_items").cast("bigint").alias("known"), F.arrays_overlap("items", F.array(F.lit(1), F.lit(4))).alias("high_impact"), F.array_min("known_items").alias("event_type"))


@query("pf23_after_close", "SELECT event_id, hour(ts) >= 16 AS after_close FROM events")
def pf23(spark, d):
    return read(spark, d, "events").select("event_id", (F.hour("ts") >= 16).alias("after_close"))


@query("f15_notice_hash", sql("actions", body="SELECT action_id, sha256(concat_ws(',', entity_id::VARCHAR, action_type, strftime(effective_date, '%Y-%m-%d'))) AS notice_hash FROM actions"))
def f15(spark, d):
    return actions(spark, d).select("action_id", F.sha2(F.concat_ws(",", F.col("entity_id").cast("string"), "action_type", F.col("effective_date").cast("string")), 256).alias("notice_hash"))


@query("str1_idempotent_notices", sql("actions", body="SELECT sha256(concat_ws(',', entity_id::VARCHAR, action_type, strftime(effective_date, '%Y-%m-%d'))) AS notice_hash, min(effective_date) AS first_date, count(*) AS copies FROM actions GROUP BY 1"))
def str1(spark, d):
    """The batch form of the idempotent ingest: one row a notice hash, the first one seen."""
    hashes = f15(spark, d).join(actions(spark, d), "action_id")
    return hashes.groupBy("notice_hash").agg(F.min("effective_date").alias("first_date"), F.count("*").alias("copies"))


@query("str2_timeline", sql("timeline", body="SELECT entity_id, action_id, valid_from, valid_to FROM timeline"))
def str2(spark, d):
    from panelspark.sources.views import timeline

    return timeline(actions(spark, d)).select("entity_id", "action_id", "valid_from", "valid_to")


@query("str3_windowed_prints", sql("prints", body="SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS prints, round(max(value * size), 4) AS premium, arg_max(event_id, (round(value * size, 4), event_id)) AS event_id FROM prints WHERE value IS NOT NULL AND size IS NOT NULL GROUP BY 1"))
def str3(spark, d):
    from panelspark.streaming.jobs import largest_prints

    return largest_prints(prints(spark, d).where("value IS NOT NULL AND size IS NOT NULL"))


@query("src4_pf1_symbols", "SELECT s_suppkey, replace(upper(trim(s_name)), '#', '-') AS symbol, CASE WHEN s_acctbal <= 0 THEN NULL ELSE n_name END AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def src4(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", P.ticker(F.col("s_name")).alias("symbol"), F.when(F.col("s_acctbal") > 0, F.col("n_name")).alias("sector"))


@query("pf6_pf7_finite_quotes", sql("chain", body="SELECT contract, CASE WHEN iv > 0.01 AND iv <= 5 THEN round(iv, 6) END AS iv, bid >= 0 AND ask > 0 AND bid <= ask AS quoted FROM chain"))
def pf6(spark, d):
    finite = F.when(~F.isnan("iv") & (F.abs("iv") != float("inf")), F.col("iv"))
    return chain(spark, d).select("contract", F.round(F.when((finite > 0.01) & (finite <= 5), finite), 6).alias("iv"), ((F.col("bid") >= 0) & (F.col("ask") > 0) & (F.col("bid") <= F.col("ask"))).alias("quoted"))


@query("f12_calendar", sql("bars", body="SELECT trade_date, count(*) AS symbols, isodow(trade_date)::INT AS weekday, date_trunc('month', trade_date)::DATE AS month, date_diff('day', trade_date, DATE '2000-01-01')::BIGINT AS days_to, (trade_date + INTERVAL 3 MONTH)::DATE AS plus_3m FROM bars GROUP BY trade_date"))
def f12(spark, d):
    g = bars(spark, d).groupBy("trade_date").agg(F.count("*").alias("symbols"))
    return g.select("trade_date", "symbols", (F.weekday("trade_date") + 1).alias("weekday"), F.trunc("trade_date", "month").alias("month"), F.datediff(F.lit("2000-01-01").cast("date"), "trade_date").cast("bigint").alias("days_to"), F.add_months("trade_date", 3).alias("plus_3m"))
