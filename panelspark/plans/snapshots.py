"""Registered queries: snapshots of option posture, their histories, smiles, densities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf_sql
from panelspark.operators import options as O
from panelspark.operators import rolling as R
from panelspark.operators import surfaces as S
from panelspark.plans.chains import ATM, a6, a7, a9, st18
from panelspark.plans.events import ALL_EM, earnings, event_metrics
from panelspark.plans.panels import W, frame, full
from panelspark.registry import SQL, query
from panelspark.sources.views import bars, chain, read, sql, with_returns


def _vol(n: int, of: str = "log_ret") -> str:
    return full(f"100 * stddev_samp({of}) OVER {frame(n)} * sqrt(252)", of, n)


SNAPS = f"sn0 AS (SELECT symbol, trade_date, close AS spot, round({_vol(10)}, 6) AS atm_iv, round({_vol(30)}, 6) AS hv30, round({_vol(10)} / nullif({_vol(63)}, 0), 6) AS term_slope, round({full(f'avg(high / close) OVER {frame(20)} / avg(close / low) OVER {frame(20)}', 'close', 20)}, 6) AS skew_25d FROM r), sn AS (SELECT *, round(atm_iv - hv30, 6) AS vrp FROM sn0)"


def snapshots(spark, d):
    """(symbol, trade_date, spot, atm_iv, hv30, term_slope, skew_25d, vrp): a snapshot of
    option posture a symbol and day; here short-dated implied volatility is that of ten
    days, skew the mean reach of highs against that of lows."""
    vol = lambda n: R.full(100 * F.stddev_samp("log_ret").over(R.last(n)) * R.YEAR, "log_ret", n)
    w = R.last(20)
    s = with_returns(bars(spark, d)).withColumns({"v10": vol(10), "v30": vol(30), "v63": vol(63), "sk": R.full(F.avg(F.col("high") / F.col("close")).over(w) / F.avg(F.col("close") / F.col("low")).over(w), "close", 20)})
    s = s.select("symbol", "trade_date", F.col("close").alias("spot"), *[F.round(c, 6).alias(k) for k, c in (("atm_iv", F.col("v10")), ("hv30", F.col("v30")), ("term_slope", F.try_divide("v10", "v63")), ("skew_25d", F.col("sk")))])
    return s.withColumn("vrp", F.round(F.col("atm_iv") - F.col("hv30"), 6))


@query("snk3_snapshot_replace", sql("r", ctes=SNAPS + ", k AS (SELECT symbol, trade_date, CASE WHEN volume % 2 = 0 THEN 'naive' ELSE 'signed' END AS convention, atm_iv, 0 AS g FROM sn JOIN (SELECT symbol, trade_date, volume FROM bars) USING (symbol, trade_date) UNION ALL SELECT symbol, trade_date, 'naive', round(atm_iv + 1, 6), 1 FROM sn WHERE year(trade_date) = 2000)", body="SELECT symbol, trade_date, convention, arg_max({'v': atm_iv}, g).v AS atm_iv FROM k GROUP BY ALL"))
def snk3(spark, d):
    """Snapshots recorded again replace those of their symbol, day and convention; here the
    year 2000 is revised."""
    s = snapshots(spark, d).select("symbol", "trade_date", "atm_iv").join(bars(spark, d).select("symbol", "trade_date", "volume"), ["symbol", "trade_date"])
    old = s.select("symbol", "trade_date", F.when(F.col("volume") % 2 == 0, "naive").otherwise("signed").alias("convention"), "atm_iv", F.lit(0).alias("as_of"))
    new = s.where(F.year("trade_date") == 2000).select("symbol", "trade_date", F.lit("naive").alias("convention"), F.round(F.col("atm_iv") + 1, 6).alias("atm_iv"), F.lit(1).alias("as_of"))
    return S.replaced(old, new, ["symbol", "trade_date", "convention"], "as_of").drop("as_of")


def _history_sql(value: str, name: str) -> str:
    return f"{name}0 AS (SELECT symbol, {value} AS v, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM sn WHERE {value} IS NOT NULL), {name}1 AS (SELECT symbol, max(v) FILTER (age = 1) AS now FROM {name}0 GROUP BY symbol), {name} AS (SELECT symbol, any_value(now) AS now, count(*) AS n, min(v) AS low, max(v) AS high, count(*) FILTER (v < now) AS below, list(v) AS pool FROM {name}0 JOIN {name}1 USING (symbol) WHERE age <= 252 GROUP BY symbol)"


def _ready(n: int) -> str:
    return f"CASE WHEN n < {n} THEN 'accumulating (' || n || '/252)' ELSE 'ready' END"


def ready(n):
    return F.when(F.col("n") < n, F.concat(F.lit("accumulating ("), F.col("n").cast("string"), F.lit("/252)"))).otherwise("ready")


RANK = f"iv AS (SELECT symbol, n, {_ready(63)} AS status, CASE WHEN n >= 63 THEN round(CASE WHEN high > low THEN 100 * (now - low) / (high - low) ELSE 50 END, 6) END AS iv_rank, CASE WHEN n >= 63 THEN round(100 * below / n, 6) END AS iv_percentile, CASE WHEN n >= 63 THEN low END AS min_iv, CASE WHEN n >= 63 THEN high END AS max_iv FROM h)"


@query("a38_iv_rank", sql("r", ctes=SNAPS + ", " + _history_sql("atm_iv", "h") + ", " + RANK, body="SELECT * FROM iv"))
def a38(spark, d):
    h = S.history(snapshots(spark, d).where("atm_iv > 0"), "atm_iv")
    rank = F.when(F.col("high") > F.col("low"), 100 * (F.col("now") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(50.0)
    ok = lambda c: F.when(F.col("n") >= 63, c)
    return h.select("symbol", "n", ready(63).alias("status"), ok(F.round(rank, 6)).alias("iv_rank"), ok(F.round(100 * F.col("below") / F.col("n"), 6)).alias("iv_percentile"), ok(F.col("low")).alias("min_iv"), ok(F.col("high")).alias("max_iv"))


BANDS = ((10, "p10"), (25, "p25"), (50, "median"), (75, "p75"), (90, "p90"))


@query("a37_vrp_bands", sql("r", ctes=SNAPS + ", " + _history_sql("vrp", "h"), body="SELECT symbol, n, now AS vrp, round(100 * below / n, 6) AS percentile, " + ", ".join(f"round(list_aggregate(pool, 'quantile_cont', {p / 100}), 6) AS {k}" for p, k in BANDS) + ", CASE WHEN 100 * below / n >= 80 THEN 'high' WHEN 100 * below / n <= 20 THEN 'low' ELSE 'normal' END AS regime FROM h WHERE n >= 21"))
def a37(spark, d):
    h = S.history(snapshots(spark, d), "vrp").where("n >= 21")
    pct = 100 * F.col("below") / F.col("n")
    return h.select("symbol", "n", F.col("now").alias("vrp"), F.round(pct, 6).alias("percentile"), *[F.round(R.quantile("all", p / 100), 6).alias(k) for p, k in BANDS], F.when(pct >= 80, "high").when(pct <= 20, "low").otherwise("normal").alias("regime"))


@query("a39_slope_skew_history", sql("r", ctes=SNAPS + ", " + _history_sql("term_slope", "h") + ", " + _history_sql("skew_25d", "k"), body=f"SELECT symbol, least(h.n, k.n) AS n, CASE WHEN least(h.n, k.n) < 63 THEN 'accumulating (' || least(h.n, k.n) || '/252)' ELSE 'ready' END AS status, CASE WHEN least(h.n, k.n) >= 63 THEN round(100 * h.below / h.n, 6) END AS slope_percentile, CASE WHEN least(h.n, k.n) >= 63 THEN round(100 * k.below / k.n, 6) END AS skew_percentile FROM h JOIN k USING (symbol)"))
def a39(spark, d):
    s = snapshots(spark, d)
    h = S.history(s, "term_slope").select("symbol", F.col("n").alias("n1"), "below").join(S.history(s, "skew_25d").select("symbol", F.col("n").alias("n2"), F.col("below").alias("below2")), "symbol")
    h = h.withColumn("n", F.least("n1", "n2"))
    ok = lambda a, b: F.when(F.col("n") >= 63, F.round(100 * F.col(a) / F.col(b), 6))
    return h.select("symbol", "n", ready(63).alias("status"), ok("below", "n1").alias("slope_percentile"), ok("below2", "n2").alias("skew_percentile"))


NEWEST = "lt AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)"


@query("f19_variance_premium", sql("r", ctes=SNAPS + ", " + NEWEST, body="SELECT symbol, atm_iv, hv30, vrp, round(atm_iv / greatest(hv30, 0.01), 6) AS ratio, CASE WHEN vrp > 8 THEN 'rich' WHEN vrp > 2 THEN 'normal' WHEN vrp > -4 THEN 'fair' WHEN vrp IS NOT NULL THEN 'discounted' END AS regime FROM lt"))
def f19(spark, d):
    s, v = R.latest(snapshots(spark, d), 1), F.col("vrp")
    return s.select("symbol", "atm_iv", "hv30", "vrp", F.round(F.col("atm_iv") / F.when(F.col("hv30").isNotNull(), F.greatest(F.col("hv30"), F.lit(0.01))), 6).alias("ratio"), F.when(v > 8, "rich").when(v > 2, "normal").when(v > -4, "fair").when(v.isNotNull(), "discounted").alias("regime"))


CONES = (10, 20, 30, 60, 90)
YZ = "0.34 / (1.34 + 31 / 29)"
CONE = f"cx AS (SELECT *, ln(open / prev_close) AS o, ln(close / open) AS c, ln(high / open) AS u, ln(low / open) AS dn, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age, lag(close) OVER {W} AS pc FROM r), cy AS (SELECT *, u * (u - c) + dn * (dn - c) AS rs FROM cx), cn AS (SELECT symbol, max(close) FILTER (age = 1) AS spot, " + ", ".join(f"CASE WHEN count(log_ret) FILTER (age <= {n}) >= {n} THEN 100 * stddev_samp(log_ret) FILTER (age <= {n}) * sqrt(252) END AS hv{n}" for n in CONES) + f", CASE WHEN count(o) FILTER (age <= 30) >= 30 THEN 100 * sqrt(greatest(0, var_samp(o) FILTER (age <= 30) + {YZ} * var_samp(c) FILTER (age <= 30) + (1 - {YZ}) * avg(rs) FILTER (age <= 30)) * 252) END AS yz30 FROM cy GROUP BY symbol)"
COVER = "cv AS (SELECT symbol, avg((abs(cx.close - pc) <= pc * atm_iv / 100 * sqrt(1 / 252))::INT) AS covered FROM cx JOIN (SELECT symbol, atm_iv FROM lt) USING (symbol) WHERE age <= 30 GROUP BY symbol)"


def cones(spark, d):
    r = with_returns(bars(spark, d)).withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))).where("age <= 91")
    o, c, u, dn = F.ln(F.col("open") / F.col("prev_close")), F.ln(F.col("close") / F.col("open")), F.ln(F.col("high") / F.col("open")), F.ln(F.col("low") / F.col("open"))
    now = R.latest(snapshots(spark, d), 1).select("symbol", "atm_iv", "hv30", "vrp")
    r = r.join(now.select("symbol", "atm_iv"), "symbol").withColumns({"o": o, "c": c, "rs": u * (u - c) + dn * (dn - c), "in_": (F.abs(F.col("close") - F.col("prev_close")) <= F.col("prev_close") * F.col("atm_iv") / 100 * F.sqrt(F.lit(1 / 252))).cast("int")})
    near = lambda x, n: F.when(F.col("age") <= n, F.col(x))
    k = 0.34 / (1.34 + 31 / 29)
    yz = F.var_samp(near("o", 30)) + k * F.var_samp(near("c", 30)) + (1 - k) * F.avg(near("rs", 30))
    hv = [F.when(F.count(near("log_ret", n)) >= n, 100 * F.stddev_samp(near("log_ret", n)) * R.YEAR).alias(f"hv{n}") for n in CONES]
    g = r.groupBy("symbol").agg(F.max(near("close", 1)).alias("spot"), *hv, F.when(F.count(near("o", 30)) >= 30, 100 * F.sqrt(F.greatest(F.lit(0.0), yz) * 252)).alias("yz30"), F.avg(near("in_", 30)).alias("covered"))
    return g.join(now.select("symbol", "atm_iv", "vrp"), "symbol").join(a38(spark, d).select("symbol", "iv_rank", "iv_percentile"), "symbol", "left")


@query("st22_vol_cones", sql("r", ctes=SNAPS + ", " + NEWEST + ", " + CONE + ", " + COVER + ", " + _history_sql("atm_iv", "h") + ", " + RANK, body="SELECT symbol, " + ", ".join(f"round(cn.hv{n}, 6) AS hv{n}" for n in CONES) + ", round(yz30, 6) AS yz30, atm_iv, vrp, CASE WHEN vrp > 5 THEN 'expensive' WHEN vrp < -5 THEN 'underpriced' ELSE 'fair' END AS vrp_regime, iv_rank, iv_percentile, round(cn.spot * atm_iv / 100 * sqrt(1 / 252), 6) AS move_1d, round(cn.spot * atm_iv / 100 * sqrt(30 / 365) * 0.8, 6) AS move_straddle, round(100 * covered, 6) AS coverage FROM cn JOIN lt USING (symbol) LEFT JOIN cv USING (symbol) LEFT JOIN iv USING (symbol)"))
def st22(spark, d):
    """Volatilities over several windows, the premium of implied over realised, rank in the
    history of implied, expected moves and how often the last 30 days kept within them."""
    g, v = cones(spark, d), F.col("vrp")
    move = F.col("spot") * F.col("atm_iv") / 100
    return g.select("symbol", *[F.round(f"hv{n}", 6).alias(f"hv{n}") for n in CONES], F.round("yz30", 6).alias("yz30"), "atm_iv", "vrp", F.when(v > 5, "expensive").when(v < -5, "underpriced").otherwise("fair").alias("vrp_regime"), "iv_rank", "iv_percentile", F.round(move * F.sqrt(F.lit(1 / 252)), 6).alias("move_1d"), F.round(move * F.sqrt(F.lit(30 / 365)) * 0.8, 6).alias("move_straddle"), F.round(100 * F.col("covered"), 6).alias("coverage"))


BRANDS = "br0 AS (SELECT p_brand AS underlying, row_number() OVER (ORDER BY p_brand) - 1 AS n FROM (SELECT DISTINCT p_brand FROM part)), ml AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, underlying FROM supplier JOIN br0 ON s_suppkey % (SELECT count(*) FROM br0) = n)"


def listed(spark, d):
    """(symbol, underlying): which chain belongs to a symbol, brands in turn."""
    from panelspark.sources.views import symbol_of

    b = read(spark, d, "part").select(F.col("p_brand").alias("underlying")).distinct()
    b = b.withColumns({"n": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("underlying")) - 1, "all": F.count("*").over(Window.partitionBy(F.lit(1)))})  # a row a chain
    s = read(spark, d, "supplier").withColumn("k", F.col("s_suppkey") % b.agg(F.max("all")).scalar())
    return s.join(b, F.col("k") == F.col("n")).select(symbol_of(F.col("s_suppkey")).alias("symbol"), "underlying")


IMPLIED = ATM + ", mv AS (SELECT underlying, dte, 100 * sum(last) / 100.0 AS implied FROM atm0 GROUP BY ALL HAVING count(*) = 2), up0 AS (SELECT symbol, min(date) AS next_date FROM earn2 WHERE upcoming GROUP BY symbol), td AS (SELECT symbol, max(trade_date) AS today FROM r GROUP BY symbol), ex AS (SELECT symbol, next_date, arg_min({'dte': dte, 'implied': implied}, dte) AS x FROM up0 JOIN td USING (symbol) JOIN ml USING (symbol) JOIN mv USING (underlying) WHERE dte >= next_date - today GROUP BY ALL), rl AS (SELECT symbol, count(*) AS prints, 100 * median(abs(reaction)) AS realised FROM em WHERE reaction IS NOT NULL GROUP BY symbol)"


@query("f8_implied_vs_realised", sql("r", "chain", ctes=ALL_EM + ", " + BRANDS + ", " + IMPLIED, body="SELECT symbol, next_date, x.dte AS dte, round(x.implied, 6) AS implied_pct, prints, round(realised, 6) AS realised_pct, CASE WHEN coalesce(prints, 0) < 3 OR coalesce(realised, 0) <= 0 THEN 'insufficient_history' WHEN x.implied / realised > 1.25 THEN 'rich' WHEN x.implied / realised < 0.75 THEN 'cheap' ELSE 'fair' END AS regime FROM ex LEFT JOIN rl USING (symbol)"))
def f8(spark, d):
    """The straddle's implied move over the next print, from the first expiry after it, against
    the median of past prints."""
    mv = O.atm(chain(spark, d)).groupBy("underlying", "dte").agg((100 * F.sum("last") / 100.0).alias("implied"), F.count("*").alias("sides")).where("sides = 2")
    due = earnings(spark, d).where("upcoming").groupBy("symbol").agg(F.min("date").alias("next_date"))
    today = bars(spark, d).groupBy("symbol").agg(F.max("trade_date").alias("today"))
    ex = due.join(today, "symbol").join(listed(spark, d), "symbol").join(mv, "underlying").where(F.col("dte") >= F.datediff("next_date", "today"))
    ex = ex.groupBy("symbol", "next_date").agg(F.min_by(F.struct("dte", "implied"), "dte").alias("x")).select("symbol", "next_date", "x.*")
    past = event_metrics(spark, d).where("reaction IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("prints"), (100 * F.percentile(F.abs("reaction"), 0.5)).alias("realised"))
    e = ex.join(past, "symbol", "left")
    ratio = F.try_divide("implied", "realised")
    thin = (F.coalesce("prints", F.lit(0)) < 3) | (F.coalesce("realised", F.lit(0.0)) <= 0)
    return e.select("symbol", "next_date", "dte", F.round("implied", 6).alias("implied_pct"), "prints", F.round("realised", 6).alias("realised_pct"), F.when(thin, "insufficient_history").when(ratio > 1.25, "rich").when(ratio < 0.75, "cheap").otherwise("fair").alias("regime"))


@query("st16_svi_smile")
def st16(spark, d):
    """A smile a chain and expiry, from out-of-the-money quotes."""
    c = chain(spark, d).where("((cp = 'P' AND strike < spot) OR (cp = 'C' AND strike >= spot)) AND iv BETWEEN 0.01 AND 4 AND oi >= 1")
    c = c.select("underlying", "dte", F.ln(F.col("strike") / F.col("spot")).alias("k"), (F.col("iv") * F.col("iv") * F.col("dte") / 365.0).alias("w"))
    return R.tidy(S.svi_fit(c, ["underlying", "dte"]), "underlying", "dte", "n", "fitted", "arbitrage_free", **{c: F.col(c) for c in ("a", "b", "rho", "m", "sigma", "rmse")})


FLAT = ATM + f", fv AS (SELECT underlying, dte, avg(iv) AS v FROM atm0 GROUP BY ALL), st AS (SELECT underlying, dte, strike, spot, dte / 365.0::DOUBLE AS t, avg(last) FILTER (cp = 'C') AS quoted FROM chain GROUP BY ALL), dm AS (SELECT *, (ln(spot / strike) + (0.045::DOUBLE + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM st JOIN fv USING (underlying, dte)), pr AS (SELECT underlying, dte, 'model' AS source, strike, spot, t, spot * ({cdf_sql('d1')}) - strike * exp(-0.045::DOUBLE * t) * ({cdf_sql('(d1 - v * sqrt(t))')}) AS price FROM dm UNION ALL SELECT underlying, dte, 'quoted', strike, spot, t, quoted FROM st WHERE quoted IS NOT NULL), dw AS (SELECT *, lag(strike) OVER w AS k0, lag(price) OVER w AS c0, lead(strike) OVER w AS k1, lead(price) OVER w AS c1 FROM pr WINDOW w AS (PARTITION BY underlying, dte, source ORDER BY strike)), db AS (SELECT *, 2 * ((c1 - price) / (k1 - strike) - (price - c0) / (strike - k0)) / (k1 - k0) AS bend FROM dw), dq AS (SELECT *, CASE WHEN bend IS NOT NULL THEN exp(0.045::DOUBLE * t) * greatest(bend, 0) END AS q FROM db), da AS (SELECT *, (q + lag(q) OVER (PARTITION BY underlying, dte, source ORDER BY strike)) / 2 * (strike - k0) AS area FROM dq), dg AS (SELECT underlying, dte, source, count(*) AS n, bool_or(c1 - price > 1e-4) AS rises, bool_or(bend < -1e-4) AS bends, sum(area) AS total, coalesce(sum(area) FILTER (k0 >= spot * 1.1::DOUBLE - 1e-9::DOUBLE), 0) AS u1, coalesce(sum(area) FILTER (strike <= spot * 0.9::DOUBLE + 1e-9::DOUBLE), 0) AS d1, coalesce(sum(area) FILTER (k0 >= spot * 1.2::DOUBLE - 1e-9::DOUBLE), 0) AS u2, coalesce(sum(area) FILTER (strike <= spot * 0.8::DOUBLE + 1e-9::DOUBLE), 0) AS d2 FROM da GROUP BY ALL), dr AS (SELECT *, CASE WHEN n < 5 THEN 'too few strikes' WHEN rises THEN 'monotonicity' WHEN bends THEN 'butterfly' WHEN coalesce(total, 0) <= 0 THEN 'no mass' END AS reason FROM dg)"


@query("st17_density", sql("chain", ctes=FLAT, body="SELECT underlying, dte, source, n, reason, CASE WHEN reason IS NULL THEN round(total, 6) END AS total, " + ", ".join(f"CASE WHEN reason IS NULL THEN round(100 * {c} / total, 6) END AS {k}" for c, k in (("u1", "up_10"), ("d1", "down_10"), ("u2", "up_20"), ("d2", "down_20"))) + " FROM dr"))
def st17(spark, d):
    """Densities of quoted call prices, mostly refused, and of prices at the expiry's
    at-the-money volatility."""
    from panelspark.functions.normal import cdf

    c = chain(spark, d)
    flat = O.atm(c).groupBy("underlying", "dte").agg(F.avg("iv").alias("v"))
    s = c.groupBy("underlying", "dte", "strike", "spot").agg(F.avg(F.when(F.col("cp") == "C", F.col("last"))).alias("quoted")).withColumn("t", F.col("dte") / 365.0)
    v, t = F.col("v"), F.col("t")
    d1 = (F.ln(F.col("spot") / F.col("strike")) + (O.RATE + v * v / 2) * t) / (v * F.sqrt(t))
    m = s.join(flat, ["underlying", "dte"]).withColumn("d1", d1)
    m = m.withColumn("price", F.col("spot") * cdf(F.col("d1")) - F.col("strike") * F.exp(-O.RATE * t) * cdf(F.col("d1") - v * F.sqrt(t)))
    cols = ("underlying", "dte", "strike", "spot", "t", "price")
    both = m.select(F.lit("model").alias("source"), *cols).unionByName(s.where("quoted IS NOT NULL").withColumn("price", F.col("quoted")).select(F.lit("quoted").alias("source"), *cols))
    return S.density(both, ["underlying", "dte", "source"])


GRID = "gc AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY underlying ORDER BY dte) AS k FROM chain) WHERE k <= 8), gd AS (SELECT *, max(k) OVER (PARTITION BY underlying) AS ne, count(*) FILTER (iv BETWEEN 0.01 AND 3) OVER (PARTITION BY underlying, dte) AS quotes FROM gc), gs AS (SELECT underlying, dte, strike / spot AS m, 100 * avg(iv) AS v FROM gd WHERE ne >= 2 AND quotes >= 3 AND iv BETWEEN 0.01 AND 3 GROUP BY ALL), gw AS (SELECT *, lag(m) OVER w AS m0, lead(m) OVER w AS m1, lead(v) OVER w AS v1 FROM gs WINDOW w AS (PARTITION BY underlying, dte ORDER BY m)), gg AS (SELECT (80 + i * 2.0::DOUBLE) / 100 AS g FROM range(21) t(i))"


@query("st20_surface_grid", sql("chain", ctes=GRID, body="SELECT underlying, dte, round(g, 2) AS moneyness, round(CASE WHEN g <= m OR m1 IS NULL THEN v ELSE v + (v1 - v) * (g - m) / (m1 - m) END, 6) AS iv FROM gw JOIN gg ON (g >= m OR m0 IS NULL) AND (g < m1 OR m1 IS NULL) UNION ALL SELECT underlying, dte, round(g, 2), NULL FROM (SELECT DISTINCT underlying, dte FROM gd WHERE ne >= 2 AND quotes < 3), gg"))
def st20(spark, d):
    return S.surface_grid(chain(spark, d))


def _of(name: str) -> str:
    return f"({SQL[name]})"


@query("st23_option_terminal", f"SELECT underlying, call_wall, put_wall, hvl, total, t.strike AS top_strike, share AS top_share, max_pain, n AS expiries, slope, s.regime, symbol, iv_rank, vrp_regime, CASE WHEN total IS NULL THEN 'no gamma' WHEN symbol IS NULL THEN 'no bars' ELSE 'ok' END AS state FROM {_of('a6_structural_levels')} a LEFT JOIN (SELECT * FROM {_of('a7_concentration')} WHERE place = 1) t USING (underlying) LEFT JOIN {_of('a9_j19_max_pain')} p USING (underlying) LEFT JOIN {_of('st18_term_structure')} s USING (underlying) LEFT JOIN (WITH {BRANDS} SELECT * FROM ml) m USING (underlying) LEFT JOIN {_of('st22_vol_cones')} c USING (symbol)")
def st23(spark, d):
    """The terminal's row of each chain and listed symbol: gamma levels, concentration, pain,
    term structure, and the symbol's cones."""
    top = a7(spark, d).where("place = 1").select("underlying", F.col("strike").alias("top_strike"), F.col("share").alias("top_share"))
    t = a6(spark, d).join(top, "underlying", "left").join(a9(spark, d).drop("pain"), "underlying", "left").join(st18(spark, d).withColumnRenamed("n", "expiries"), "underlying", "left")
    t = t.join(listed(spark, d), "underlying", "left").join(st22(spark, d).select("symbol", "iv_rank", "vrp_regime"), "symbol", "left")
    return t.withColumn("state", F.when(F.col("total").isNull(), "no gamma").when(F.col("symbol").isNull(), "no bars").otherwise("ok"))
