"""Registered queries: peer tables of all symbols. Multiples and growth are made from the
suppliers' balances and what they sold in the last year and the year before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import peers as P
from panelspark.operators import rolling as R
from panelspark.registry import SQL, query
from panelspark.sources.views import bars, read, sectors, sql, symbol_of


def members(spark, d) -> DataFrame:
    """(symbol, sector, industry); every seventh symbol has no industry."""
    return sectors(spark, d).withColumn("industry", F.when(F.substring("symbol", 2, 6).cast("int") % 7 != 0, F.col("industry")))


def supplied(spark, d) -> DataFrame:
    """(symbol, peer): every tenth symbol names the three after it."""
    s = read(spark, d, "supplier").where("s_suppkey % 10 = 0").select("s_suppkey", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i"))
    known = read(spark, d, "supplier").select((F.col("s_suppkey")).alias("p"))
    s = s.withColumn("p", F.col("s_suppkey") + F.col("i")).join(known, "p", "left_semi")
    return s.select(symbol_of(F.col("s_suppkey")).alias("symbol"), symbol_of(F.col("p")).alias("peer"))


def metrics(spark, d) -> DataFrame:
    """(symbol, metric, kind, value)."""
    lines = read(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint").alias("rev"), F.round(F.col("l_extendedprice") * (0.05 - F.col("l_discount")) * 100).cast("bigint").alias("earn"))
    end = lines.agg(F.max("day")).scalar()
    new, old = F.col("day") > F.add_months(end, -12), (F.col("day") > F.add_months(end, -24)) & (F.col("day") <= F.add_months(end, -12))
    of = lambda c, when: F.sum(F.when(when, F.col(c)))
    g = lines.groupBy("l_suppkey").agg(of("rev", new).alias("r1"), of("rev", old).alias("r0"), of("earn", new).alias("e1"), of("l_quantity", new).alias("q1"), of("l_quantity", old).alias("q0"))
    g = g.join(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    per = lambda c: F.try_divide(F.col("s_acctbal"), F.col(c).cast("double"))
    up = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) - 1
    row = lambda k, kind, c: F.struct(F.lit(k).alias("metric"), F.lit(kind).alias("kind"), c.cast("double").alias("value"))
    rows = F.array(row("price_sales", "value", per("r1")), row("forward_pe", "value", per("e1")), row("price_unit", "value", per("q1")), row("revenue_growth", "growth", up("r1", "r0")), row("volume_growth", "growth", up("q1", "q0")))
    long = g.select(symbol_of(F.col("s_suppkey")).alias("symbol"), F.inline(rows))
    mom = R.latest(R.momentum(bars(spark, d)), 1).select("symbol", F.lit("mom_12_1").alias("metric"), F.lit("momentum").alias("kind"), F.col("mom_12_1").alias("value"))
    return long.unionByName(mom)


PEERS = f"""mb AS (SELECT symbol, sector, CASE WHEN substr(symbol, 2, 6)::INT % 7 <> 0 THEN industry END AS industry FROM sectors),
gv AS (SELECT 'S' || lpad(a.s_suppkey::VARCHAR, 6, '0') AS focus, 'S' || lpad(b.s_suppkey::VARCHAR, 6, '0') AS peer, 'supplied' AS cohort FROM supplier a JOIN supplier b ON b.s_suppkey - a.s_suppkey BETWEEN 1 AND 3 WHERE a.s_suppkey % 10 = 0),
ap AS (SELECT a.symbol AS focus, b.symbol AS peer, CASE WHEN a.industry IS NULL THEN 'sector' ELSE 'industry' END AS cohort FROM mb a JOIN mb b ON a.symbol <> b.symbol AND CASE WHEN a.industry IS NULL THEN a.sector = b.sector ELSE a.industry = b.industry END WHERE a.symbol NOT IN (SELECT focus FROM gv) UNION ALL SELECT * FROM gv),
ps AS (SELECT * FROM ap QUALIFY row_number() OVER (PARTITION BY focus ORDER BY peer) <= {P.CAP}), st AS (SELECT focus, peer AS symbol, cohort FROM ps UNION ALL SELECT DISTINCT focus, focus, cohort FROM ps),
ln AS (SELECT l_suppkey, l_shipdate::DATE AS day, l_quantity AS q, round(l_extendedprice * (1 - l_discount) * 100)::BIGINT AS rev, round(l_extendedprice * (0.05::DOUBLE - l_discount) * 100)::BIGINT AS earn FROM lineitem), en AS (SELECT (max(day) - INTERVAL 12 MONTH)::DATE AS a, (max(day) - INTERVAL 24 MONTH)::DATE AS b FROM ln),
fu AS (SELECT l_suppkey, sum(rev) FILTER (day > a)::DOUBLE AS r1, sum(rev) FILTER (day > b AND day <= a)::DOUBLE AS r0, sum(earn) FILTER (day > a)::DOUBLE AS e1, sum(q) FILTER (day > a)::DOUBLE AS q1, sum(q) FILTER (day > b AND day <= a)::DOUBLE AS q0 FROM ln, en GROUP BY 1),
fx AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, s_acctbal / nullif(r1, 0) AS ps, s_acctbal / nullif(e1, 0) AS pe, s_acctbal / nullif(q1, 0) AS pu, r1 / nullif(r0, 0) - 1 AS rg, q1 / nullif(q0, 0) - 1 AS vg FROM fu JOIN supplier ON s_suppkey = l_suppkey),
mo AS (SELECT symbol, mom_12_1 FROM ({SQL['w12_momentum']}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1),
me AS (SELECT symbol, 'price_sales' AS metric, 'value' AS kind, ps AS value FROM fx UNION ALL SELECT symbol, 'forward_pe', 'value', pe FROM fx UNION ALL SELECT symbol, 'price_unit', 'value', pu FROM fx UNION ALL SELECT symbol, 'revenue_growth', 'growth', rg FROM fx UNION ALL SELECT symbol, 'volume_growth', 'growth', vg FROM fx UNION ALL SELECT symbol, 'mom_12_1', 'momentum', mom_12_1 FROM mo),
mm AS (SELECT symbol, metric, kind, kind = 'value' AND coalesce(value <= 0, false) AS nm, CASE WHEN NOT (kind = 'value' AND coalesce(value <= 0, false)) THEN value END AS value FROM me),
rr AS (SELECT *, count(value) OVER (PARTITION BY focus, metric) AS peer_n, rank() OVER (PARTITION BY focus, metric ORDER BY value NULLS LAST) - 1 AS below FROM st JOIN mm USING (symbol)),
pp AS (SELECT focus, symbol, cohort, metric, kind, value, peer_n, CASE WHEN nm THEN 'NM' WHEN kind = 'value' AND peer_n < {P.LEAST} THEN 'insufficient-peers' WHEN value IS NULL THEN 'missing' ELSE 'ok' END AS state,
  CASE WHEN value IS NOT NULL AND NOT (kind = 'value' AND peer_n < {P.LEAST}) AND peer_n >= 2 THEN CASE WHEN kind = 'value' THEN 100 - 100.0::DOUBLE * below / (peer_n - 1) ELSE 100.0::DOUBLE * below / (peer_n - 1) END END AS pct FROM rr)"""


@query("r15_peer_metrics", sql("sectors", "r", ctes=PEERS, body="SELECT focus, symbol, cohort, metric, round(value, 6) AS value, peer_n, state, round(pct, 6) AS pct FROM pp"))
def r15_metrics(spark, d) -> DataFrame:
    p = P.metric_percentiles(P.peer_sets(members(spark, d), supplied(spark, d)), metrics(spark, d))
    return p.select("focus", "symbol", "cohort", "metric", F.round("value", 6).alias("value"), "peer_n", "state", F.round("pct", 6).alias("pct"))


@query("r15_j20_peer_comparison", sql("sectors", "r", ctes=PEERS + ", gg AS (SELECT focus, symbol, cohort, count(pct) AS n_metrics, avg(pct) FILTER (kind = 'value') AS v, avg(pct) FILTER (kind = 'growth') AS g, avg(pct) FILTER (kind = 'momentum') AS m, max(value) FILTER (kind = 'momentum') AS mom FROM pp GROUP BY ALL)", body="SELECT focus, symbol, cohort, n_metrics, round(v, 6) AS valuation_pct, round(g, 6) AS growth_pct, round(m, 6) AS momentum_pct, round(list_avg(list_filter([v, g, m], lambda x: x IS NOT NULL)), 6) AS value_score, CASE WHEN v IS NOT NULL AND mom IS NOT NULL THEN CASE WHEN v >= 50 THEN 'Cheap' ELSE 'Rich' END || ' & ' || CASE WHEN mom > 0 THEN 'Strengthening' ELSE 'Weakening' END END AS quadrant FROM gg"))
def r15_table(spark, d) -> DataFrame:
    return P.table(P.metric_percentiles(P.peer_sets(members(spark, d), supplied(spark, d)), metrics(spark, d)))


_POOL = "st AS (SELECT sector AS focus, symbol, 'sector' AS cohort FROM sectors)"
_START, _END = PEERS.index("st AS (SELECT focus, peer"), PEERS.index(",\nln AS (")
VALUES = (PEERS[:_START] + _POOL + PEERS[_END:]).replace("kind = 'value' AND peer_n <", "peer_n <").replace("'price_unit', 'value', pu FROM fx UNION ALL SELECT symbol, ", "")


@query("a41_value_scores", sql("sectors", "r", ctes=VALUES + ", gg AS (SELECT focus, symbol, avg(pct) FILTER (kind = 'value') AS v, avg(pct) FILTER (kind = 'growth') AS g, avg(pct) FILTER (kind = 'momentum') AS m, count(value) / count(*) AS cov FROM pp GROUP BY ALL)", body="SELECT focus AS sector, symbol, round(v, 6) AS cheapness, round(g, 6) AS growth, round(m, 6) AS momentum, round((coalesce(v * 0.5::DOUBLE, 0) + coalesce(g * 0.25::DOUBLE, 0) + coalesce(m * 0.25::DOUBLE, 0)) / nullif(CASE WHEN v IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN g IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN m IS NOT NULL THEN 0.25 ELSE 0 END, 0)::DOUBLE, 6) AS value_score, round(cov, 6) AS coverage, cov < 0.5 AS low_coverage FROM gg"))
def a41(spark, d) -> DataFrame:
    """Value scores within each sector."""
    own = sectors(spark, d).select(F.col("sector").alias("focus"), "symbol", F.lit("sector").alias("cohort"))
    five = metrics(spark, d).where("metric <> 'price_unit'")
    return P.value_scores(P.metric_percentiles(own, five, gated=("value", "growth", "momentum"))).withColumnRenamed("focus", "sector")
