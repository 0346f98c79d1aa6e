"""Registered queries over a history of option chains: dated levels, and their touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf_sql
from panelspark.operators import options as O
from panelspark.operators import rolling as R
from panelspark.operators import touches as T
from panelspark.plans.chains import FLIP, GEX
from panelspark.plans.panels import W
from panelspark.registry import query
from panelspark.sources.views import CTE, bars, dated_chain, read, sql, symbol_of

POINTS, NULLS, TOLERANCE = 41, 25, 0.01
_CHAIN = "dq AS (SELECT l_partkey, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS as_of, count(*) AS oi, sum(l_quantity)::BIGINT AS volume FROM lineitem GROUP BY ALL), " + CTE["chain"].replace("LEFT JOIN (SELECT l_partkey, count(*) AS oi, sum(l_quantity) AS volume FROM lineitem GROUP BY 1)", "JOIN dq").replace("p_brand AS underlying", "p_brand || '|' || strftime(as_of, '%Y-%m-%d') AS underlying")
LEVELS = (
    f"lv AS (WITH {_CHAIN}, {GEX} SELECT underlying, arg_max(strike, (round(call, 4), -strike)) FILTER (strike >= spot) / 100 AS call_wall, arg_max(strike, (round(put, 4), strike)) FILTER (strike <= spot) / 100 AS put_wall FROM bs GROUP BY underlying), "
    f"fl AS (WITH {_CHAIN}, {FLIP.replace('range(201)', f'range({POINTS})').replace('i / 200', f'i / {POINTS - 1}')} SELECT underlying, round(arg_min(x, (round(abs(x - spot), 6), i)), 6) / 100 AS gamma_flip FROM gx GROUP BY underlying), "
    "ul AS (SELECT split_part(underlying, '|', 1) AS brand, split_part(underlying, '|', 2)::DATE AS as_of, call_wall, put_wall, gamma_flip FROM lv LEFT JOIN fl USING (underlying)), "
    "br0 AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS k, count(*) OVER () AS nb FROM (SELECT DISTINCT p_brand AS brand FROM part)), "
    "sy AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, brand FROM supplier JOIN br0 ON s_suppkey % nb = k), "
    "dl AS (SELECT u.symbol, as_of, call_wall * close AS call_wall, put_wall * close AS put_wall, gamma_flip * close AS gamma_flip FROM (SELECT symbol, as_of, call_wall, put_wall, gamma_flip FROM ul JOIN sy USING (brand)) u ASOF JOIN bars b ON u.symbol = b.symbol AND u.as_of >= b.trade_date)"
)


def levels(spark, d) -> DataFrame:
    """(symbol, as_of, call_wall, put_wall, gamma_flip) in prices, a row a symbol and quarter:
    brands' chains are bound to suppliers in turn."""
    c = O.clean(dated_chain(spark, d))
    found = O.levels(O.gex_by_strike(c)).select("underlying", "call_wall", "put_wall").join(O.gamma_flip(c, POINTS), "underlying", "left")
    part = lambda i: F.split_part("underlying", F.lit("|"), F.lit(i))
    found = found.select(part(1).alias("brand"), part(2).cast("date").alias("as_of"), *[(F.col(k) / 100).alias(k) for k in ("call_wall", "put_wall")], (F.col("flip") / 100).alias("gamma_flip"))
    brands = read(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    brands = brands.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("brand")) - 1)  # a row a brand
    symbols = read(spark, d, "supplier").select(symbol_of(F.col("s_suppkey")).alias("symbol"), (F.col("s_suppkey") % F.greatest(F.lit(1), brands.agg(F.count("*")).scalar())).alias("k"))
    return T.priced(found.join(symbols.join(brands, "k"), "brand").select("symbol", "as_of", "call_wall", "put_wall", "gamma_flip"), bars(spark, d))


@query("w28_dated_levels", sql("bars", ctes=LEVELS, body="SELECT symbol, as_of, round(call_wall, 6) AS call_wall, round(put_wall, 6) AS put_wall, round(gamma_flip, 6) AS gamma_flip FROM dl"))
def dated_levels(spark, d) -> DataFrame:
    return R.tidy(levels(spark, d), "symbol", "as_of", **{k: F.col(k) for k in T.KINDS})


_FIVE = lambda a, b: f"CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {a} AND {b}) = 5 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {a} AND {b}) END"
_BELOW, _ABOVE = f"before < {{0}} AND high >= {{0}} * (1 - {TOLERANCE}::DOUBLE)", f"before > {{0}} AND low <= {{0}} * (1 + {TOLERANCE}::DOUBLE)"
STUDY = LEVELS + f""", t0 AS (SELECT symbol, trade_date, high, low, close, lag(close) OVER {W} AS before, lead(close) OVER {W} AS after, {_FIVE('5 PRECEDING', '1 PRECEDING')} AS calm, CASE WHEN lead(close, 5) OVER {W} IS NOT NULL THEN {_FIVE('CURRENT ROW', '4 FOLLOWING')} END AS wild FROM bars),
t AS (SELECT t0.*, call_wall, put_wall, gamma_flip FROM (SELECT * FROM t0 WHERE before IS NOT NULL AND after IS NOT NULL) t0 ASOF LEFT JOIN dl ON t0.symbol = dl.symbol AND t0.trade_date > dl.as_of),
s AS (SELECT symbol, 'call_wall' AS level_type, after < close AS turned, after / close - 1 AS move FROM t WHERE {_BELOW.format('call_wall')} UNION ALL SELECT symbol, 'put_wall', after > close, after / close - 1 FROM t WHERE {_ABOVE.format('put_wall')}
  UNION ALL SELECT symbol, 'gamma_flip', coalesce(wild > calm, false), (wild - calm) / greatest(calm, 1e-4::DOUBLE) FROM t WHERE (before - gamma_flip) * (close - gamma_flip) < 0),
sg AS (SELECT symbol, level_type, count(*) AS touches, count(*) FILTER (turned) AS reversals, avg(move) AS move, CASE WHEN level_type = 'call_wall' THEN 'call' ELSE 'put' END AS side FROM s GROUP BY symbol, level_type),
z0 AS (SELECT symbol, i, lo * 1.05::DOUBLE + ('0x' || substr(md5(symbol || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (hi * 0.95::DOUBLE - lo * 1.05::DOUBLE) AS level FROM (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY symbol), range({NULLS}) g(i)),
q AS (SELECT symbol, 'call' AS side, i, count(*) AS n, count(*) FILTER (after < close) AS k FROM t JOIN z0 USING (symbol) WHERE {_BELOW.format('level')} GROUP BY ALL UNION ALL SELECT symbol, 'put', i, count(*), count(*) FILTER (after > close) FROM t JOIN z0 USING (symbol) WHERE {_ABOVE.format('level')} GROUP BY ALL),
m AS (SELECT symbol, side, avg(k / n) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(k / n) ELSE 0.08 END AS sd FROM q WHERE n >= 3 GROUP BY ALL),
j AS (SELECT symbol, level_type, touches, reversals, move, reversals / touches AS rate, coalesce(m, 0.5) AS m, coalesce(sd, 0.08) AS sd FROM sg LEFT JOIN m USING (symbol, side)),
k AS (SELECT *, touches >= 3 AND sd > 1e-9 AS tested, CASE WHEN touches >= 3 AND sd > 1e-9 THEN (rate - m) / sd ELSE 0 END AS z FROM j),
o AS (SELECT symbol, level_type, touches, reversals, round(rate, 6) AS rate, round(m, 6) AS baseline, round(sd, 6) AS spread, round(z, 6) AS z, round(CASE WHEN tested THEN 1 - {cdf_sql('z')} ELSE 0.5 END, 6) AS p, round(move, 6) AS mean_move FROM k)"""


@query("w28_gamma_level_study", sql("bars", ctes=STUDY, body="SELECT *, p < 0.05 AND rate > baseline AS significant FROM o"))
def w28(spark, d) -> DataFrame:
    return T.study(bars(spark, d), levels(spark, d), NULLS, TOLERANCE)
