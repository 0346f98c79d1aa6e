"""Registered queries: state labels, composites and published rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import cross as C
from panelspark.operators import rolling as R
from panelspark.plans.cross_sections import VECTOR, a33
from panelspark.plans.events import ALL_EM, event_metrics
from panelspark.plans.panels import PREV, W, frame
from panelspark.registry import query
from panelspark.sources.views import bars, by_symbol, sql, with_returns


@query("pf25_pf26_regimes", sql("r", ctes=f"t AS (SELECT symbol, trade_date, close / avg(close) OVER {frame(200)} - 1 AS tr, stddev_samp(ret) OVER {frame(21)} * sqrt(252) AS v1, stddev_samp(ret) OVER {frame(252)} * sqrt(252) AS v2 FROM r), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)", body="SELECT symbol, CASE WHEN tr > 0.05 THEN 'bullish' WHEN tr < -0.05 THEN 'bearish' ELSE 'neutral' END AS stance, CASE WHEN v1 > 1.25 * v2 THEN 'elevated' WHEN v1 < 0.75 * v2 THEN 'calm' ELSE 'normal' END AS vol_regime FROM l"))
def pf25(spark, d):
    r = with_returns(bars(spark, d)).withColumns({"tr": F.col("close") / F.avg("close").over(R.last(200)) - 1, "v1": F.stddev_samp("ret").over(R.last(21)), "v2": F.stddev_samp("ret").over(R.last(252))})
    stance = F.when(F.col("tr") > 0.05, "bullish").when(F.col("tr") < -0.05, "bearish").otherwise("neutral")
    regime = F.when(F.col("v1") > 1.25 * F.col("v2"), "elevated").when(F.col("v1") < 0.75 * F.col("v2"), "calm").otherwise("normal")
    return R.latest(r, 1).select("symbol", stance.alias("stance"), regime.alias("vol_regime"))


SCORES = "z AS (SELECT symbol, CASE WHEN momentum_12_1 IS NOT NULL THEN greatest(-1, least(1, momentum_12_1 / 100)) END AS mo, CASE WHEN vol_21d IS NOT NULL THEN greatest(-1, least(1, 1 - vol_21d / nullif(vol_252d, 0))) END AS ca, CASE WHEN skewness IS NOT NULL THEN greatest(-1, least(1, skewness)) END AS sk FROM vec), yy AS (SELECT *, (coalesce(mo * 0.5, 0) + coalesce(ca * 0.3, 0) + coalesce(sk * 0.2, 0)) / nullif(CASE WHEN mo IS NULL THEN 0 ELSE 0.5 END + CASE WHEN ca IS NULL THEN 0 ELSE 0.3 END + CASE WHEN sk IS NULL THEN 0 ELSE 0.2 END, 0) AS s FROM z)"


@query("a40_a41_composite", sql("r", "br", ctes=VECTOR + ", " + SCORES, body="SELECT symbol, round(50 + 50 * s, 6) AS score, (coalesce(mo > 0.1, false)::INT + coalesce(ca > 0.1, false)::INT + coalesce(sk > 0.1, false)::INT)::INT AS bulls, (coalesce(mo < -0.1, false)::INT + coalesce(ca < -0.1, false)::INT + coalesce(sk < -0.1, false)::INT)::INT AS bears FROM yy"))
def a40(spark, d):
    """Weighted mean of the factors that are there, from 0 to 100, and votes."""
    clip = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    v = a33(spark, d).select("symbol", clip(F.col("momentum_12_1") / 100).alias("mo"), clip(1 - F.try_divide("vol_21d", "vol_252d")).alias("ca"), clip(F.col("skewness")).alias("sk"))
    weights = {"mo": 0.5, "ca": 0.3, "sk": 0.2}
    total = sum(F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items())
    present = sum(F.when(F.col(k).isNull(), 0.0).otherwise(w) for k, w in weights.items())
    votes = lambda ok: sum(F.coalesce(ok(F.col(k)), F.lit(False)).cast("int") for k in weights)
    return v.select("symbol", F.round(50 + 50 * F.try_divide(total, present), 6).alias("score"), votes(lambda c: c > 0.1).alias("bulls"), votes(lambda c: c < -0.1).alias("bears"))


CHECKS = (("trend", "above", "tr > 0", "tr < -0.1"), ("momentum", "mo", "mo > 0", "mo < -0.2"), ("vol", "v", "v < 8", "v > 20"))


@query("a42_checklist", sql("r", ctes=f"t AS (SELECT symbol, trade_date, close / avg(close) OVER {frame(200)} - 1 AS tr, lag(close, 21) OVER {W} / lag(close, 252) OVER {W} - 1 AS mo, stddev_samp(ret) OVER {frame(63)} * sqrt(252) AS v FROM r), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1), k AS (" + " UNION ALL ".join(f"SELECT symbol, CASE WHEN {good} THEN 'pass' WHEN {bad} THEN 'fail' WHEN {good.split()[0]} IS NULL THEN 'skip' ELSE 'warn' END AS state FROM l" for _, _, good, bad in CHECKS) + ")", body="SELECT symbol, " + ", ".join(f"count(*) FILTER (state = '{s}') AS n_{s}" for s in ("pass", "warn", "fail", "skip")) + " FROM k GROUP BY symbol"))
def a42(spark, d):
    lag = lambda n: F.lag("close", n).over(by_symbol())
    r = with_returns(bars(spark, d)).withColumns({"tr": F.col("close") / F.avg("close").over(R.last(200)) - 1, "mo": F.try_divide(lag(21), lag(252)) - 1, "v": F.stddev_samp("ret").over(R.last(63)) * R.YEAR})
    l = R.latest(r, 1)  # noqa: E741
    states = [F.when(F.expr(good), "pass").when(F.expr(bad), "fail").when(F.col(good.split()[0]).isNull(), "skip").otherwise("warn").alias(k) for k, _, good, bad in CHECKS]
    k = l.select("symbol", *states).unpivot("symbol", [c[0] for c in CHECKS], "rule", "state")
    return k.groupBy("symbol").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "skip")])


@query("sn2_universe_metrics", sql("r", "br", ctes=VECTOR, body="SELECT v.*, CASE WHEN n < 63 THEN 'thin' ELSE 'ok' END AS history_state, count(*) OVER () AS universe FROM vec v"))
def sn2(spark, d):
    return a33(spark, d).withColumns({"history_state": F.when(F.col("n") < 63, "thin").otherwise("ok"), "universe": F.count("*").over(Window.partitionBy(F.lit(1)))})  # a row a symbol


@query("sn3_daily_brief", sql("r", ctes=ALL_EM + f", t AS (SELECT symbol, trade_date, ret, CASE WHEN count(ret) OVER {PREV} = 20 THEN (ret - avg(ret) OVER {PREV}) / stddev_samp(ret) OVER {PREV} END AS z, volume / avg(volume) OVER {PREV} AS vr FROM r), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1), le AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)", body="SELECT l.symbol, l.trade_date, round(l.ret, 6) AS ret, round(z, 6) AS z, round(vr, 6) AS volume_ratio, le.date AS print_date, surprise, le.reaction AS reaction, CASE WHEN le.date IS NULL THEN 'unavailable' WHEN surprise IS NULL THEN 'not meaningful' ELSE 'live' END AS earnings_state FROM l LEFT JOIN le USING (symbol)"))
def sn3(spark, d):
    w = R.before(20)
    r = with_returns(bars(spark, d)).withColumns({"z": F.when(F.count("ret").over(w) == 20, (F.col("ret") - F.avg("ret").over(w)) / F.stddev_samp("ret").over(w)), "vr": F.col("volume") / F.avg("volume").over(w)})
    l = R.tidy(R.latest(r, 1), "symbol", "trade_date", ret=F.col("ret"), z=F.col("z"), volume_ratio=F.col("vr"))  # noqa: E741
    e = event_metrics(spark, d).groupBy("symbol").agg(F.max_by(F.struct(F.col("date").alias("print_date"), "surprise", "reaction"), "date").alias("x")).select("symbol", "x.*")
    state = F.when(F.col("print_date").isNull(), "unavailable").when(F.col("surprise").isNull(), "not meaningful").otherwise("live")
    return l.join(e, "symbol", "left").withColumn("earnings_state", state)


@query("sn4_a12_heatmap_header", sql("r", body="SELECT count(*) AS tiles, count(ret) AS covered, count(*) FILTER (ret > 0) AS up, count(*) FILTER (ret < 0) AS down FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1)"))
def sn4(spark, d):
    return R.latest(with_returns(bars(spark, d)), 1).agg(F.count("*").alias("tiles"), F.count("ret").alias("covered"), F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.col("ret") < 0).alias("down"))


@query("r13_notable_ranking", sql("r", body="SELECT symbol, round(ret, 6) AS ret, row_number() OVER (ORDER BY round(abs(ret), 9) DESC NULLS LAST, symbol) AS place FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1".replace("row_number() OVER (ORDER BY round(abs(ret), 9) DESC NULLS LAST, symbol) AS place FROM r QUALIFY", "place FROM (SELECT *, row_number() OVER (ORDER BY round(abs(ret), 9) DESC NULLS LAST, symbol) AS place FROM (SELECT * FROM r QUALIFY") + "))"))
def r13(spark, d):
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(F.round(F.abs("ret"), 9)), "symbol")  # a row a symbol
    return R.latest(with_returns(bars(spark, d)), 1).select("symbol", F.round("ret", 6).alias("ret"), F.row_number().over(w).alias("place"))


@query("r18_squeeze_screen", sql("r", ctes="a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM r), g AS (SELECT symbol, median(close * volume) FILTER (age <= 20) AS dv, sum(volume) FILTER (age <= 63) / nullif(avg(volume) FILTER (age <= 20), 0) / 10 AS dtc, max(high) FILTER (age <= 252) AS hi, min(low) FILTER (age <= 252) AS lo, max(close) FILTER (age = 1) AS c FROM a GROUP BY symbol)", body="SELECT symbol, round(dtc, 6) AS days_to_cover, round(40 * least(1, greatest(0, dtc / 10)) + 30 * (c - lo) / nullif(hi - lo, 0) + 30 * least(1, greatest(0, ln(dv) / 20)), 6) AS score FROM g WHERE dv >= 1000"))
def r18(spark, d):
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    r = with_returns(bars(spark, d)).withColumn("age", age)
    near = lambda c, n: F.when(F.col("age") <= n, c)
    g = r.groupBy("symbol").agg(F.percentile(near(F.col("close") * F.col("volume"), 20), 0.5).alias("dv"), (F.try_divide(F.sum(near(F.col("volume"), 63)), F.avg(near(F.col("volume"), 20))) / 10).alias("dtc"), F.max(near(F.col("high"), 252)).alias("hi"), F.min(near(F.col("low"), 252)).alias("lo"), F.max(near(F.col("close"), 1)).alias("c")).where("dv >= 1000")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return R.tidy(g, "symbol", days_to_cover=F.col("dtc"), score=40 * unit(F.col("dtc") / 10) + 30 * F.try_divide(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo")) + 30 * unit(F.ln("dv") / 20))


@query("st14_leak_check")
def st14(spark, d):
    """Rank correlation of a signal with forward returns, beside that with returns dealt
    anew by hash inside each date: a leak shows as a real correlation far above."""
    from panelspark.plans.cross_sections import panel

    p = panel(spark, d).where("f1 IS NOT NULL AND sig IS NOT NULL")
    w = Window.partitionBy("trade_date")
    p = p.withColumns({"i": F.row_number().over(w.orderBy("symbol")), "j": F.row_number().over(w.orderBy(F.xxhash64("symbol", "trade_date")))})
    s = p.select("trade_date", F.col("j").alias("i"), F.col("f1").alias("shuffled"))
    p = p.join(s, ["trade_date", "i"])
    real, fake = C.rank_ic(p, "sig", "f1"), C.rank_ic(p, "sig", "shuffled")
    return real.agg(F.count("*").alias("dates"), F.round(F.avg("ic"), 6).alias("mean_ic")).crossJoin(fake.agg(F.round(F.avg("ic"), 6).alias("shuffled_ic")))  # two single rows


@query("ml1_training_set", sql("r", ctes=f"t AS (SELECT symbol, trade_date, close / avg(close) OVER {frame(20)} - 1 AS x1, stddev_samp(ret) OVER {frame(20)} AS x2, close / lag(close, 5) OVER {W} - 1 AS x3, volume / avg(volume) OVER {frame(20)} AS x4, CASE WHEN count(ret) OVER {frame(20)} = 20 THEN 1 END AS ready, lead(close, 5) OVER {W} / close - 1 AS f FROM r)", body="SELECT symbol, trade_date, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3, round(x4, 6) AS x4, CASE WHEN f > 0.1 THEN 2 WHEN f < -0.1 THEN 0 ELSE 1 END AS label FROM t WHERE ready = 1 AND x3 IS NOT NULL AND f IS NOT NULL"))
def ml1(spark, d):
    r = with_returns(bars(spark, d)).withColumns({
        "x1": F.col("close") / F.avg("close").over(R.last(20)) - 1, "x2": F.stddev_samp("ret").over(R.last(20)), "x3": F.col("close") / F.lag("close", 5).over(by_symbol()) - 1, "x4": F.col("volume") / F.avg("volume").over(R.last(20)),
        "ready": F.count("ret").over(R.last(20)) == 20, "f": F.lead("close", 5).over(by_symbol()) / F.col("close") - 1,
    }).where("ready AND x3 IS NOT NULL AND f IS NOT NULL")
    label = F.when(F.col("f") > 0.1, 2).when(F.col("f") < -0.1, 0).otherwise(1)
    return R.tidy(r.withColumn("label", label), "symbol", "trade_date", "label", **{c: F.col(c) for c in ("x1", "x2", "x3", "x4")})


@query("ml3_ml4_ml6_walk_forward")
def ml4(spark, d):
    """A class-weighted forest fitted on the first three quarters of dates, less a gap of
    10, scored on the rest: hits and mean probability for each predicted class."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = ml1(spark, d).withColumn("day", F.datediff("trade_date", F.lit("1970-01-01").cast("date")))
    cut = rows.agg(F.percentile_approx("day", 0.75)).first()[0]
    if cut is None:
        return spark.createDataFrame([], "predicted int, n bigint, hits bigint, mean_p double")
    # a constant for each class: a join on the class would put all its rows into one task
    share = rows.groupBy("label").agg(F.count("*").alias("c")).collect()
    rows = rows.withColumn("weight", F.coalesce(*[F.when(F.col("label") == r["label"], 1 / r["c"]) for r in share]))
    rows = VectorAssembler(inputCols=["x1", "x2", "x3", "x4"], outputCol="x").transform(rows)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=20, maxDepth=4, seed=7).fit(rows.where(F.col("day") < cut - 10))
    out = model.transform(rows.where(F.col("day") >= cut)).withColumn("p", F.array_max(vector_to_array("probability")))
    return out.groupBy(F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("hits"), F.round(F.avg("p"), 4).alias("mean_p"))


@query("f16_beta_shrinkage", sql("r", "br", ctes="p AS (SELECT r.symbol, ret, bench_ret FROM r JOIN br USING (trade_date) WHERE ret IS NOT NULL AND bench_ret IS NOT NULL), b AS (SELECT symbol, count(*) AS n, covar_samp(ret, bench_ret) / var_samp(bench_ret) AS beta, greatest(0, var_samp(ret) - pow(covar_samp(ret, bench_ret), 2) / var_samp(bench_ret)) / (count(*) - 2) / var_samp(bench_ret) AS se2 FROM p GROUP BY symbol), c AS (SELECT *, avg(beta) OVER () AS mb, var_samp(beta) OVER () AS vb FROM b)", body="SELECT symbol, round(beta, 6) AS beta, round(0.67 * beta + 0.33, 6) AS blume, round((vb * beta + se2 * mb) / (vb + se2), 6) AS vasicek FROM c"))
def f16(spark, d):
    from panelspark.plans.risk import paired

    g = paired(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.covar_samp("ret", "bench_ret").alias("c"), F.var_samp("bench_ret").alias("vx"), F.var_samp("ret").alias("vy"))
    g = g.withColumns({"beta": F.col("c") / F.col("vx"), "se2": F.greatest(F.lit(0.0), F.col("vy") - F.col("c") * F.col("c") / F.col("vx")) / (F.col("n") - 2) / F.col("vx")})
    w = Window.partitionBy(F.lit(1))  # a row a symbol
    g = g.withColumns({"mb": F.avg("beta").over(w), "vb": F.var_samp("beta").over(w)})
    return R.tidy(g, "symbol", beta=F.col("beta"), blume=0.67 * F.col("beta") + 0.33, vasicek=(F.col("vb") * F.col("beta") + F.col("se2") * F.col("mb")) / (F.col("vb") + F.col("se2")))
