"""Registered queries over tables that are kept: publication, upserts, the trial ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf, cdf_sql
from panelspark.operators import rolling as R
from panelspark.plans import cross_sections, events, feeds
from panelspark.plans.research import stacked
from panelspark.plans.risk import DEFLATED, expected_maximum, unbiased
from panelspark.registry import SQL, query
from panelspark.sources import payloads, store
from panelspark.sources.views import bars, read, sql, with_returns


@query("snk5_publish_and_prune", "WITH d AS (SELECT event_type AS provider, ts::DATE AS day, event_id, user_id FROM events), k AS (SELECT *, dense_rank() OVER (PARTITION BY provider ORDER BY day DESC) AS k FROM d) SELECT provider, strftime(day, '%Y-%m-%d') AS snapshot_id, (k - 1)::INT AS age, count(*) AS rows, sum(user_id)::BIGINT AS keys FROM k WHERE k <= 2 GROUP BY ALL")
def snk5(spark, d) -> DataFrame:
    """Each provider's last three days are published in turn, and then one that breaks the
    contract; read back as history: two snapshots stay, the newest good one is published."""
    base = store.shared(spark)
    events = read(spark, d, "events").select(F.col("event_type").alias("provider"), F.to_date("ts").alias("day"), "event_id", "user_id")
    days = events.select("provider", "day").distinct()
    newest = days.withColumn("k", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("day")))).where("k <= 3").orderBy("day", "provider").collect()
    terms = {"event_id": F.col("event_id") < 0, "user_id": F.col("user_id") < 0}
    for r in newest:  # three a provider
        own = events.where((F.col("provider") == r.provider) & (F.col("day") == r.day)).select("event_id", "user_id")
        store.publish(own, base, r.provider, r.day.isoformat(), terms)
        if r.k == 1:
            try:
                store.publish(own.withColumn("user_id", -1 - F.col("user_id")), base, r.provider, "broken", terms)
            except store.ContractBroken:
                continue
            raise AssertionError("a broken snapshot was published")
    h = store.history(spark, base)
    return h.groupBy("provider", "snapshot_id", "age").agg(F.count("*").alias("rows"), F.sum("user_id").alias("keys"))


@query("snk6_j13_current", "WITH d AS (SELECT event_type AS provider, ts::DATE AS day, event_id, user_id FROM events), k AS (SELECT *, dense_rank() OVER (PARTITION BY provider ORDER BY day DESC) AS k FROM d) SELECT provider, strftime(day, '%Y-%m-%d') AS snapshot_id, event_id, user_id FROM k WHERE k = 1 AND provider LIKE 'p%'")
def snk6(spark, d) -> DataFrame:
    """Payload rows of what is published, of providers with a prefix: pointers joined to
    payloads, both no older than a day."""
    base = store.shared(spark)
    events = read(spark, d, "events").select(F.col("event_type").alias("provider"), F.to_date("ts").alias("day"), "event_id", "user_id")
    for r in events.groupBy("provider").agg(F.max("day").alias("day"), F.date_sub(F.max("day"), 1).alias("before")).collect():  # a row a provider
        for day in (r.before, r.day):
            store.publish(events.where((F.col("provider") == r.provider) & (F.col("day") == day)).select("event_id", "user_id"), base, r.provider, day.isoformat())
    found = store.history(spark, base, prefix="p", newest=1, ttl_hours=24)
    if found is None:
        return spark.createDataFrame([], "provider string, snapshot_id string, event_id bigint, user_id bigint")
    return found.select("provider", "snapshot_id", "event_id", "user_id")


REVISED = "n AS (SELECT symbol, trade_date, CASE WHEN year(trade_date) = 1998 THEN close * 2 ELSE close END AS close, volume FROM bars)"


@query("str4_incremental_upsert", sql("bars", ctes=REVISED, body="SELECT symbol, trade_date, round(close, 6) AS close, volume, (SELECT max(trade_date) FROM bars) AS fresh_to FROM n"))
def str4(spark, d) -> DataFrame:
    """Bars arrive in batches of two years and then a revision of 1998; each batch rewrites
    the months it touches, and one that is seen again nothing. ``fresh_to``: the last date."""
    base = store.shared(spark)
    b = bars(spark, d).select("symbol", "trade_date", "close", "volume")
    month = F.date_format("trade_date", "yyyy-MM")
    span = b.agg(F.min(F.year("trade_date")).alias("a"), F.max(F.year("trade_date")).alias("z")).first()
    batches = [b.where(F.year("trade_date").between(y, y + 1)) for y in range(span.a, span.z + 1, 2)] if span.a is not None else []
    batches.append(b.where(F.year("trade_date") == 1998).withColumn("close", F.col("close") * 2))
    for i, batch in enumerate(batches):
        store.upsert(batch, base, ["symbol", "trade_date"], i, month)
    store.upsert(batches[0].withColumn("close", F.lit(0.0)), base, ["symbol", "trade_date"], 0, month)  # a replay
    held = store.read_table(spark, base, b.schema)
    return held.select("symbol", "trade_date", F.round("close", 6).alias("close"), "volume").withColumn("fresh_to", F.lit(held.agg(F.max("trade_date")).scalar()))


def _trials(spark, d) -> tuple[str, int]:
    """A ledger with the trials of the price signals, each at two thresholds, and its count."""
    base = store.shared(spark)
    names = stacked(spark, d).select("signal").distinct()
    for run, threshold in (("first", "top 10%"), ("second", "top 20%"), ("second", "top 20%")):
        n = store.record(names.withColumn("variant", F.lit(threshold)), base, run)
    return base, n


TRIED = f"tr AS (SELECT DISTINCT signal, variant FROM ({SQL['u4_stacked_panels']}), (VALUES ('top 10%'), ('top 20%')) v(variant))"


@query("snk4_append_ledger", f"WITH {TRIED} SELECT signal, variant, CASE WHEN variant = 'top 10%' THEN 'first' ELSE 'second' END AS run FROM tr")
def snk4(spark, d) -> DataFrame:
    """Three runs are recorded, one of them twice; the ledger holds each trial once."""
    return store.ledger(spark, _trials(spark, d)[0])


@query("st7_deflated_by_ledger", sql("r", ctes=DEFLATED + f", {TRIED}, em(k, x) AS (VALUES " + ", ".join(f"({k}, {expected_maximum(k)!r}::DOUBLE)" for k in range(1, 65)) + "), k AS (SELECT greatest(1, count(*)) AS k FROM tr)", body=f"SELECT symbol, n, k.k AS trials, round({cdf_sql('(sr / s - x)')}, 6) AS deflated FROM z, k JOIN em USING (k)"))
def st7(spark, d) -> DataFrame:
    """The deflated Sharpe ratio by as many trials as the ledger holds."""
    trials = _trials(spark, d)[1]
    g = with_returns(bars(spark, d)).groupBy("symbol").agg(F.count("ret").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2")).where("n >= 4")
    skew, kurt = unbiased(F.col("n"), F.col("g1"), F.col("g2"))
    sr = F.col("sr")
    z = sr / F.sqrt(F.greatest(F.lit(1e-12), (1 - skew * sr + (kurt + 2) / 4 * sr * sr) / (F.col("n") - 1)))
    return R.tidy(g.withColumns({"trials": F.lit(trials), "z": z}), "symbol", "n", "trials", deflated=cdf(F.col("z") - expected_maximum(trials)))


#: Hours that a panel stays fresh.
PANELS = (("view", "event log", 4), ("click", "event log", 24), ("purchase", "event log", 96), ("signup", "event log", 24), ("error", "event log", 24))
NOW = "2024-01-31 00:00:00"
_AGE = f"greatest(0, epoch_us(TIMESTAMP '{NOW}' - as_of) / 3.6e9::DOUBLE)"


@query("pf28_panel_receipts", f"WITH p(panel, source, ttl) AS (VALUES {', '.join(f"('{k}', '{s}', {h}::DOUBLE)" for k, s, h in PANELS)}), s AS (SELECT event_type AS panel, user_id AS key, CASE WHEN event_type <> 'error' THEN max(ts) END AS as_of, CASE WHEN event_type = 'click' AND user_id % 7 = 0 THEN ['rate', 'spread'] ELSE [] END AS assumed FROM events GROUP BY event_type, user_id), r AS (SELECT c_custkey AS key, p.*, as_of, coalesce(assumed, []) AS assumed, s.key IS NOT NULL AS present FROM (SELECT DISTINCT c_custkey FROM customer) CROSS JOIN p LEFT JOIN s ON s.panel = p.panel AND s.key = c_custkey) SELECT key, panel, source, as_of, CASE WHEN as_of IS NULL THEN '' WHEN {_AGE} < 1 THEN '<1h old' WHEN {_AGE} < 48 THEN round_even({_AGE}, 0)::INT || 'h old' ELSE round_even({_AGE} / 24, 0)::INT || 'd old' END AS age_text, CASE WHEN NOT present THEN 'unavailable' WHEN len(assumed) > 0 THEN 'assumed' WHEN as_of IS NULL THEN 'no_asof' WHEN epoch_us(TIMESTAMP '{NOW}' - as_of) / 3.6e9::DOUBLE > ttl THEN 'stale' ELSE 'live' END AS state, CASE WHEN len(assumed) > 0 THEN 'assumed inputs: rate, spread' ELSE '' END AS note FROM r")
def pf28(spark, d) -> DataFrame:
    """Receipts of every customer's panels; errors have no as-of, and some clicks assumed
    inputs."""
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("panel"), F.col("user_id").alias("key")).agg(F.max("ts").alias("as_of"))
    assumed = F.when((F.col("panel") == "click") & (F.col("key") % 7 == 0), F.array(F.lit("rate"), F.lit("spread"))).otherwise(F.array().cast("array<string>"))
    seen = e.withColumns({"as_of": F.when(F.col("panel") != "error", F.col("as_of")), "assumed": assumed})
    return payloads.panel_receipts(read(spark, d, "customer").select(F.col("c_custkey").alias("key")), list(PANELS), seen, NOW)


_SECTIONS = f"""SELECT 'drift' AS section, symbol AS name, place::DOUBLE AS value FROM ({SQL['r17_f23_drift_screen']}) UNION ALL SELECT 'value', company::VARCHAR, score FROM ({SQL['r16_value_screen']}) UNION ALL SELECT 'squeeze', symbol, score::DOUBLE FROM ({SQL['r18_short_squeeze']}) UNION ALL SELECT 'excluded', reason, n::DOUBLE FROM ({SQL['a14_exclusion_ledger']})
UNION ALL SELECT 'upcoming', symbol, (date - l)::DOUBLE FROM (SELECT DISTINCT symbol, date FROM ({SQL['src12_pf13_earnings']}) WHERE upcoming), (SELECT min(date) AS l FROM ({SQL['src12_pf13_earnings']}) WHERE upcoming) WHERE date - l BETWEEN 0 AND 7"""


@query("sn1_published_radar", f"WITH s AS ({_SECTIONS}) SELECT section, name, round(value, 6) AS value FROM s UNION ALL SELECT 'meta', 'scored', count(*) FILTER (section IN ('drift', 'value', 'squeeze'))::DOUBLE FROM s UNION ALL SELECT 'meta', 'excluded', coalesce(sum(value) FILTER (section = 'excluded'), 0)::DOUBLE FROM s")
def sn1(spark, d) -> DataFrame:
    """The radar: drift, value and squeeze rows, what was excluded, the prints of the week from
    the first one due, and counts; published behind its contract, then read as published. A
    second radar with a broken row is built, and doesn't become the published one."""
    part = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
    due = events.earnings(spark, d).where("upcoming").select("symbol", "date").distinct()
    due = due.withColumn("days", F.datediff("date", F.lit(due.agg(F.min("date")).first()[0]))).where("days BETWEEN 0 AND 7")
    s = part(events.r17(spark, d), "drift", "symbol", "place").unionByName(part(cross_sections.r16(spark, d), "value", "company", "score")).unionByName(part(feeds.r18_short(spark, d), "squeeze", "symbol", "score"))
    s = s.unionByName(part(cross_sections.a14(spark, d), "excluded", "reason", "n")).unionByName(part(due, "upcoming", "symbol", "days")).withColumn("value", F.round("value", 6))
    counts = s.agg(F.count_if(F.col("section").isin("drift", "value", "squeeze")).cast("double").alias("scored"), F.coalesce(F.sum(F.when(F.col("section") == "excluded", F.col("value"))), F.lit(0.0)).alias("excluded"))
    meta = counts.select(F.inline(F.array(*[F.struct(F.lit("meta").alias("section"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("scored", "excluded")])))
    base, terms = store.shared(spark), {"name": F.length("name") == 0, "value": F.isnan("value")}
    store.publish(s.unionByName(meta), base, "radar", "first", terms)
    try:
        store.publish(s.withColumn("value", F.lit(float("nan"))), base, "radar", "second", terms)
    except store.ContractBroken:
        return store.history(spark, base, "radar", newest=1).select("section", "name", "value")
    raise AssertionError("a broken radar was published")
