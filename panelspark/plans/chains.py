"""Registered queries: option chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.normal import ROOT_2PI, cdf_sql
from panelspark.operators import options as O
from panelspark.operators import rolling as R
from panelspark.registry import query
from panelspark.sources.views import chain, sql

#: Inversion of prices is beyond SQL; where a volatility has to be repaired, this differs.
CLEAN = """c0 AS (SELECT *, CASE WHEN iv BETWEEN 0.05 AND 3.5 THEN iv END AS sound, iv IS NULL OR iv NOT BETWEEN 0.05 AND 4 AS bad FROM chain),
c1 AS (SELECT *, median(sound) OVER (PARTITION BY underlying, dte) AS m1, median(sound) OVER (PARTITION BY underlying) AS m2 FROM c0),
c2 AS (SELECT *, count(*) FILTER (bid > 0) OVER (PARTITION BY underlying) AS nq, count(*) OVER (PARTITION BY underlying) AS nu FROM c1 WHERE strike > 0 AND dte >= 0 AND (oi > 0 OR volume > 0)),
cl AS (SELECT contract, underlying, spot, strike, dte, cp, CASE WHEN bad THEN coalesce(m1, m2, 0.2) ELSE iv END::DOUBLE AS iv, oi, volume, last, bid, ask FROM c2 WHERE 4 * nq < nu OR bid > 0)"""
PDF = f"(exp(-d1 * d1 / 2) / {ROOT_2PI!r}::DOUBLE)"
GREEKS = CLEAN + f""", g0 AS (SELECT *, greatest(dte, 1) / 365.0::DOUBLE AS t FROM cl), g1 AS (SELECT *, (ln(spot / strike) + (0.045::DOUBLE + iv * iv / 2) * t) / (iv * sqrt(t)) AS d1 FROM g0),
g2 AS (SELECT *, d1 - iv * sqrt(t) AS d2, {PDF} AS p1 FROM g1), g3 AS (SELECT *, {cdf_sql('d1')} AS n1, {cdf_sql('d2')} AS n2, strike * exp(-0.045::DOUBLE * t) AS disc FROM g2),
g AS (SELECT *, CASE WHEN cp = 'C' THEN n1 ELSE n1 - 1 END AS delta, p1 / (spot * iv * sqrt(t)) AS gamma, spot * p1 * sqrt(t) / 100 AS vega, (-spot * p1 * iv / (2 * sqrt(t)) + CASE WHEN cp = 'C' THEN -0.045::DOUBLE * disc * n2 ELSE 0.045::DOUBLE * disc * (1 - n2) END) / 365 AS theta,
 -p1 * d2 / iv AS vanna, -p1 * (2 * 0.045::DOUBLE * t - d2 * iv * sqrt(t)) / (2 * t * iv * sqrt(t)) / 365 AS charm, CASE WHEN cp = 'C' THEN spot * n1 - disc * n2 ELSE disc * (1 - n2) - spot * (1 - n1) END AS price FROM g3)"""
GEX = GREEKS + """, gx AS (SELECT *, gamma * greatest(volume, oi) * 100 * spot * spot * 0.01::DOUBLE AS gex, CASE WHEN cp = 'C' THEN 1 ELSE -1 END AS sg, greatest(volume, oi) * 100 AS w FROM g),
bs AS (SELECT underlying, strike, spot, sum(sg * gex) AS net, sum(CASE WHEN cp = 'C' THEN gex ELSE 0 END) AS call, sum(CASE WHEN cp = 'P' THEN gex ELSE 0 END) AS put, sum(sg * vanna * w * spot) AS vanna, sum(sg * charm * w * spot) AS charm FROM gx GROUP BY ALL)"""


def cleaned(spark, d):
    return O.clean(chain(spark, d))


@query("pf10_clean_chain", sql("chain", ctes=CLEAN, body="SELECT contract, underlying, cp, dte, strike, round(iv, 6) AS iv FROM cl"))
def pf10(spark, d):
    return cleaned(spark, d).select("contract", "underlying", "cp", "dte", "strike", F.round("iv", 6).alias("iv"))


G = ("delta", "gamma", "vega", "theta", "vanna", "charm", "price")


@query("f3_greeks", sql("chain", ctes=GREEKS, body="SELECT contract, " + ", ".join(f"round({c}, 8) AS {c}" for c in G) + " FROM g"))
def f3(spark, d):
    return R.tidy(O.with_greeks(cleaned(spark, d)), "contract", digits=8, **{c: F.col(c) for c in G})


@query("a4_gex_by_strike", sql("chain", ctes=GEX, body="SELECT underlying, strike, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("net", "call", "put", "vanna", "charm")) + " FROM bs"))
def a4(spark, d):
    return R.tidy(O.gex_by_strike(cleaned(spark, d)), "underlying", "strike", digits=4, **{c: F.col(c) for c in ("net", "call", "put", "vanna", "charm")})


@query("a5_strike_bins", sql("chain", ctes=GEX, body="SELECT underlying, round(strike / 5) * 5 AS bin, round(sum(net), 4) AS net FROM bs GROUP BY ALL"))
def a5(spark, d):
    return O.gex_by_strike(cleaned(spark, d)).groupBy("underlying", (F.round(F.col("strike") / 5) * 5).alias("bin")).agg(F.round(F.sum("net"), 4).alias("net"))


@query("a6_structural_levels", sql("chain", ctes=GEX, body="SELECT underlying, arg_max(strike, (round(call, 4), -strike)) FILTER (strike >= spot) AS call_wall, arg_max(strike, (round(put, 4), strike)) FILTER (strike <= spot) AS put_wall, arg_max(strike, (round(abs(net), 4), strike)) AS hvl, round(sum(net), 4) AS total FROM bs GROUP BY underlying"))
def a6(spark, d):
    return O.levels(O.gex_by_strike(cleaned(spark, d)))


@query("a7_concentration", sql("chain", ctes=GEX, body="SELECT underlying, strike, round(abs(net) / nullif(sum(abs(net)) OVER (PARTITION BY underlying), 0), 6) AS share, row_number() OVER (PARTITION BY underlying ORDER BY round(abs(net), 4) DESC, strike) AS place FROM bs QUALIFY place <= 5"))
def a7(spark, d):
    w = Window.partitionBy("underlying")
    b = O.gex_by_strike(cleaned(spark, d)).withColumns({"s": F.try_divide(F.abs("net"), F.sum(F.abs("net")).over(w)), "place": F.row_number().over(w.orderBy(F.desc(F.round(F.abs("net"), 4)), "strike"))})
    return b.where("place <= 5").select("underlying", "strike", F.round("s", 6).alias("share"), "place")


@query("w31_cumulative_gex", sql("chain", ctes=GEX, body="SELECT underlying, strike, round(sum(net) OVER (PARTITION BY underlying ORDER BY strike), 4) AS cumulative FROM bs"))
def w31(spark, d):
    return O.gex_by_strike(cleaned(spark, d)).select("underlying", "strike", F.round(F.sum("net").over(Window.partitionBy("underlying").orderBy("strike")), 4).alias("cumulative"))


@query("a8_a47_put_call", sql("chain", body="SELECT underlying, dte, grouping(dte)::INT AS total, sum(CASE WHEN cp = 'C' THEN oi END)::BIGINT AS call_oi, sum(CASE WHEN cp = 'P' THEN oi END)::BIGINT AS put_oi, round(sum(CASE WHEN cp = 'P' THEN oi END) / nullif(sum(CASE WHEN cp = 'C' THEN oi END), 0), 6) AS oi_ratio, round(sum(CASE WHEN cp = 'P' THEN volume END) / nullif(sum(CASE WHEN cp = 'C' THEN volume END), 0), 6) AS volume_ratio FROM chain GROUP BY ROLLUP (underlying, dte) HAVING underlying IS NOT NULL"))
def a8(spark, d):
    side = lambda cp, c: F.sum(F.when(F.col("cp") == cp, F.col(c)))
    g = chain(spark, d).rollup("underlying", "dte").agg(F.grouping("dte").cast("int").alias("total"), side("C", "oi").alias("call_oi"), side("P", "oi").alias("put_oi"), F.round(F.try_divide(side("P", "oi"), side("C", "oi")), 6).alias("oi_ratio"), F.round(F.try_divide(side("P", "volume"), side("C", "volume")), 6).alias("volume_ratio"))
    return g.where("underlying IS NOT NULL")


@query("a9_j19_max_pain", sql("chain", ctes="s AS (SELECT DISTINCT underlying, strike AS settle FROM chain), p AS (SELECT c.underlying, settle, sum(oi * greatest(0, CASE WHEN cp = 'C' THEN settle - strike ELSE strike - settle END)) AS pain FROM chain c JOIN s USING (underlying) GROUP BY ALL)", body="SELECT underlying, arg_min(settle, (pain, settle)) AS max_pain, min(pain) AS pain FROM p GROUP BY underlying"))
def a9(spark, d):
    """Open interest is summed by strike first, so a chain has strikes times strikes rows,
    whatever the number of contracts."""
    c = chain(spark, d).groupBy("underlying", "strike", "cp").agg(F.sum("oi").alias("oi"))
    s = c.select("underlying", F.col("strike").alias("settle")).distinct()
    loss = F.greatest(F.lit(0.0), F.when(F.col("cp") == "C", F.col("settle") - F.col("strike")).otherwise(F.col("strike") - F.col("settle")))
    p = c.join(s, "underlying").groupBy("underlying", "settle").agg(F.sum(F.col("oi") * loss).alias("pain"))
    return p.groupBy("underlying").agg(F.min_by("settle", F.struct("pain", "settle")).alias("max_pain"), F.min("pain").alias("pain"))


@query("a10_liquidity_spread", sql("chain", body="SELECT underlying, count(*) AS quotes, round(median((ask - bid) / ((ask + bid) / 2)), 6) AS spread FROM chain WHERE abs(strike - spot) <= 0.2 * spot AND ask > 0 GROUP BY underlying HAVING count(*) >= 5"))
def a10(spark, d):
    c = chain(spark, d).where("abs(strike - spot) <= 0.2 * spot AND ask > 0")
    return c.groupBy("underlying").agg(F.count("*").alias("quotes"), F.round(F.percentile((F.col("ask") - F.col("bid")) / ((F.col("ask") + F.col("bid")) / 2), 0.5), 6).alias("spread")).where("quotes >= 5")


ATM = "atm1 AS (SELECT underlying, dte, cp, arg_min({'strike': strike, 'iv': iv, 'last': last, 'contract': contract}, (abs(strike - spot), strike, contract)) AS x FROM chain WHERE abs(strike - spot) <= 0.05 * spot AND iv > 0.01 AND iv <= 5 GROUP BY ALL), atm0 AS (SELECT underlying, dte, cp, x.strike AS strike, x.iv AS iv, x.last AS last, x.contract AS contract FROM atm1)"


@query("j16_atm_contracts", sql("chain", ctes=ATM, body="SELECT underlying, dte, cp, strike, round(iv, 6) AS iv, round(last, 6) AS last, contract FROM atm0"))
def j16(spark, d):
    return O.atm(chain(spark, d)).select("underlying", "dte", "cp", "strike", F.round("iv", 6).alias("iv"), F.round("last", 6).alias("last"), "contract")


@query("j17_nearest_expiry", sql("chain", body="SELECT underlying, arg_min(dte, (abs(dte - 30), dte)) AS dte FROM chain WHERE dte >= 7 GROUP BY underlying"))
def j17(spark, d):
    return chain(spark, d).where("dte >= 7").groupBy("underlying").agg(F.min_by("dte", F.struct(F.abs(F.col("dte") - 30), "dte")).alias("dte"))


@query("st18_term_structure", sql("chain", ctes=ATM + ", m AS (SELECT underlying, dte, avg(iv) AS iv FROM atm0 GROUP BY ALL), s AS (SELECT underlying, count(*) AS n, covar_pop(sqrt(dte), iv) / nullif(var_pop(sqrt(dte)), 0) AS slope FROM m GROUP BY underlying)", body="SELECT underlying, n, round(slope, 6) AS slope, CASE WHEN slope > 0.001 THEN 'contango' WHEN slope < -0.001 THEN 'backwardation' WHEN slope IS NOT NULL THEN 'flat' END AS regime FROM s"))
def st18(spark, d):
    m = O.atm(chain(spark, d)).groupBy("underlying", "dte").agg(F.avg("iv").alias("iv")).withColumn("x", F.sqrt("dte"))
    s = m.groupBy("underlying").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "iv"), F.var_pop("x")).alias("s"))
    return s.select("underlying", "n", F.round("s", 6).alias("slope"), F.when(F.col("s") > 0.001, "contango").when(F.col("s") < -0.001, "backwardation").when(F.col("s").isNotNull(), "flat").alias("regime"))


@query("st19_skew_25d", sql("chain", ctes=GREEKS + ", k AS (SELECT underlying, dte, arg_min(iv, (round(abs(delta - 0.25), 9), contract)) FILTER (cp = 'C') AS c, arg_min(iv, (round(abs(delta + 0.25), 9), contract)) FILTER (cp = 'P') AS p FROM g GROUP BY ALL)", body="SELECT underlying, dte, round(p / c, 6) AS skew, round(c - p, 6) AS risk_reversal FROM k"))
def st19(spark, d):
    g = O.with_greeks(cleaned(spark, d))
    near = lambda cp, x: F.min_by(F.when(F.col("cp") == cp, F.col("iv")), F.when(F.col("cp") == cp, F.struct(F.round(F.abs(F.col("delta") - x), 9), "contract")))
    k = g.groupBy("underlying", "dte").agg(near("C", 0.25).alias("c"), near("P", -0.25).alias("p"))
    return k.select("underlying", "dte", F.round(F.col("p") / F.col("c"), 6).alias("skew"), F.round(F.col("c") - F.col("p"), 6).alias("risk_reversal"))


@query("pf14_otm_wings", sql("chain", body="SELECT contract, underlying, dte, cp, round(ln(strike / spot), 6) AS k, round(iv * iv * dte / 365.0::DOUBLE, 6) AS w FROM chain WHERE ((cp = 'P' AND strike < spot) OR (cp = 'C' AND strike >= spot)) AND iv BETWEEN 0.01 AND 4 AND oi >= 1"))
def pf14(spark, d):
    c = chain(spark, d).where("((cp = 'P' AND strike < spot) OR (cp = 'C' AND strike >= spot)) AND iv BETWEEN 0.01 AND 4 AND oi >= 1")
    return R.tidy(c, "contract", "underlying", "dte", "cp", k=F.ln(F.col("strike") / F.col("spot")), w=F.col("iv") * F.col("iv") * F.col("dte") / 365.0)


@query("pf15_pf16_nearest_strikes", sql("chain", body="SELECT underlying, strike, row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - spot), strike) AS place FROM (SELECT DISTINCT underlying, strike, spot FROM chain WHERE strike BETWEEN 0.7 * spot AND 1.3 * spot) QUALIFY place <= 10 OR place % 5 = 0"))
def pf15(spark, d):
    s = chain(spark, d).where("strike BETWEEN 0.7 * spot AND 1.3 * spot").select("underlying", "strike", "spot").distinct()
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("underlying").orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")))
    return s.where("place <= 10 OR place % 5 = 0").select("underlying", "strike", "place")


@query("pf17_unusual_activity", sql("chain", body="SELECT underlying, contract, round(last * volume * 100, 4) AS premium, round(volume / nullif(oi, 0), 6) AS ratio, row_number() OVER (PARTITION BY underlying ORDER BY last * volume * 100 DESC, contract) AS place FROM chain WHERE volume >= 100 AND last * volume * 100 >= 25000 AND volume > oi QUALIFY place <= 10"))
def pf17(spark, d):
    c = chain(spark, d).withColumn("premium", F.col("last") * F.col("volume") * 100).where("volume >= 100 AND premium >= 25000 AND volume > oi")
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("underlying").orderBy(F.desc("premium"), "contract"))).where("place <= 10")
    return c.select("underlying", "contract", F.round("premium", 4).alias("premium"), F.round(F.try_divide("volume", "oi"), 6).alias("ratio"), "place")


@query("pf8_pf9_chain_quality", sql("chain", ctes="q AS (SELECT underlying, dte, bool_or(cp = 'C' AND oi > 0)::INT + bool_or(cp = 'P' AND oi > 0)::INT + bool_or(cp = 'C' AND bid <= ask AND ask > 0)::INT + bool_or(cp = 'P' AND bid <= ask AND ask > 0)::INT + coalesce(bool_or(cp = 'C' AND abs(strike - spot) <= 5 AND iv > 0.01), false)::INT + coalesce(bool_or(cp = 'P' AND abs(strike - spot) <= 5 AND iv > 0.01), false)::INT AS quality FROM chain GROUP BY ALL)", body="SELECT underlying, max(quality) AS quality, arg_max(dte, (quality, -dte)) AS best_dte FROM q GROUP BY underlying"))
def pf8(spark, d):
    has = lambda c: F.bool_or(F.expr(c)).cast("int")
    q = chain(spark, d).groupBy("underlying", "dte").agg(sum(has(f"cp = '{s}' AND {c}") for s in "CP" for c in ("oi > 0", "bid <= ask AND ask > 0", "abs(strike - spot) <= 5 AND iv > 0.01")).alias("quality"))
    return q.groupBy("underlying").agg(F.max("quality").alias("quality"), F.max_by("dte", F.struct("quality", -F.col("dte"))).alias("best_dte"))


@query("f6_f7_expected_moves", sql("chain", ctes=ATM + ", p AS (SELECT underlying, dte, avg(iv) AS iv, sum(last) AS straddle, count(*) AS sides FROM atm0 GROUP BY ALL)", body="SELECT underlying, dte, round(0.85 * 100 * iv * sqrt(dte / 365.0), 6) AS expected_move, round(CASE WHEN sides = 2 THEN straddle END, 6) AS straddle, round(100 * iv / sqrt(365.0), 6) AS one_day FROM p"))
def f6(spark, d):
    p = O.atm(chain(spark, d)).groupBy("underlying", "dte").agg(F.avg("iv").alias("iv"), F.sum("last").alias("s"), F.count("*").alias("sides"))
    return R.tidy(p, "underlying", "dte", expected_move=0.85 * 100 * F.col("iv") * F.sqrt(F.col("dte") / 365.0), straddle=F.when(F.col("sides") == 2, F.col("s")), one_day=100 * F.col("iv") / F.sqrt(F.lit(365.0)))


@query("f9_contract_codes", sql("chain", body="SELECT contract, replace(underlying, 'Brand#', 'B') || strftime(DATE '2024-01-05' + dte, '%y%m%d') || cp || lpad((strike * 1000)::BIGINT::VARCHAR, 8, '0') AS code FROM chain"))
def f9(spark, d):
    return chain(spark, d).select("contract", contract_code().alias("code"))


def contract_code():
    day = F.date_format(F.date_add(F.lit("2024-01-05").cast("date"), F.col("dte")), "yyMMdd")
    return F.concat(F.regexp_replace("underlying", "Brand#", "B"), day, F.col("cp"), F.lpad((F.col("strike") * 1000).cast("bigint").cast("string"), 8, "0"))


@query("src10_contract_parse", sql("chain", body="SELECT contract, replace(underlying, 'Brand#', 'B') AS root, DATE '2024-01-05' + dte AS expiry, cp, strike FROM chain"))
def src10(spark, d):
    """Codes taken apart again: root, expiry, side, strike."""
    part = lambda n: F.regexp_extract(contract_code(), r"^(.+?)(\d{6})([CP])(\d{8})$", n)
    return chain(spark, d).select("contract", part(1).alias("root"), F.to_date(part(2), "yyMMdd").alias("expiry"), part(3).alias("cp"), (part(4).cast("bigint") / 1000).alias("strike"))


@query("j15_matrix", sql("chain", ctes="m AS (SELECT underlying, dte, strike, avg(iv) FILTER (cp = 'C') AS ci, avg(iv) FILTER (cp = 'P') AS pi, sum(oi) FILTER (cp = 'C') AS co, sum(oi) FILTER (cp = 'P') AS po FROM chain GROUP BY ALL)", body="SELECT underlying, dte, strike, round(coalesce(ci, pi), 6) AS call_iv, round(coalesce(pi, ci), 6) AS put_iv, coalesce(co, 0)::BIGINT AS call_oi, coalesce(po, 0)::BIGINT AS put_oi FROM m"))
def j15(spark, d):
    m = chain(spark, d).groupBy("underlying", "dte", "strike").pivot("cp", ["C", "P"]).agg(F.avg("iv").alias("iv"), F.sum("oi").alias("oi"))
    return m.select("underlying", "dte", "strike", F.round(F.coalesce("C_iv", "P_iv"), 6).alias("call_iv"), F.round(F.coalesce("P_iv", "C_iv"), 6).alias("put_iv"), F.coalesce("C_oi", F.lit(0)).alias("call_oi"), F.coalesce("P_oi", F.lit(0)).alias("put_oi"))


@query("f5_implied_vol")
def f5(spark, d):
    """Volatility found again from the model's price: within the bisection's width."""
    g = O.with_greeks(cleaned(spark, d))
    iv = O.implied_vol(F.col("price"), F.col("spot"), F.col("strike"), F.col("t"), F.col("cp") == "C")
    return g.withColumn("found", iv).select("contract", F.round("iv", 6).alias("iv"), F.round("found", 6).alias("found"), F.round("vega", 6).alias("vega"))


FLIP = CLEAN + f""", gr AS (SELECT cl.*, i, spot * (1 - 0.3 + 2 * 0.3 * i / 200)::DOUBLE AS s FROM cl, range(201) r(i)), gd AS (SELECT *, greatest(dte, 1) / 365.0::DOUBLE AS t FROM gr), ge AS (SELECT *, (ln(s / strike) + (0.045::DOUBLE + iv * iv / 2) * t) / (iv * sqrt(t)) AS d1 FROM gd),
gn AS (SELECT underlying, i, s, spot, sum(CASE WHEN cp = 'C' THEN 1 ELSE -1 END * {PDF} * s / (iv * sqrt(t)) * greatest(volume, oi)) AS net FROM ge GROUP BY ALL), gl AS (SELECT *, lead(net) OVER w AS net1, lead(s) OVER w AS s1 FROM gn WINDOW w AS (PARTITION BY underlying ORDER BY i)), gx AS (SELECT *, s - net * (s1 - s) / (net1 - net) AS x FROM gl WHERE net * net1 < 0)"""


@query("j18_w32_st21_gamma_flip", sql("chain", ctes=FLIP, body="SELECT underlying, round(arg_min(x, (round(abs(x - spot), 6), i)), 6) AS flip FROM gx GROUP BY underlying"))
def st21(spark, d):
    return O.gamma_flip(cleaned(spark, d))
