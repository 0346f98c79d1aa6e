"""Peer tables: who is compared with whom, and percentiles of many metrics in each set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAP, LEAST = 8, 5


def peer_sets(members: DataFrame, supplied: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """(focus, symbol, cohort) of ``members`` (symbol, sector, industry): a focus's supplied
    peers (``supplied``: symbol, peer) if it has any, else the others of its industry, else,
    where it has no industry, of its sector; ``cap`` at most, by name; and the focus itself
    in each set. A focus without peers has no rows. Each group's first cap + 1 names are
    enough, so no pair beyond them is made."""
    def first(by: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(by).orderBy("symbol"))
        return members.where(F.col(by).isNotNull()).withColumn("k", k).where(F.col("k") <= cap + 1).select(by, F.col("symbol").alias("peer"))

    own = members.select(F.col("symbol").alias("focus"), "sector", "industry")
    by_industry = own.where("industry IS NOT NULL").join(first("industry"), "industry").select("focus", "peer", F.lit("industry").alias("cohort"))
    by_sector = own.where("industry IS NULL AND sector IS NOT NULL").join(first("sector"), "sector").select("focus", "peer", F.lit("sector").alias("cohort"))
    pairs = by_industry.unionByName(by_sector)
    if supplied is not None:
        given = supplied.where("peer IS NOT NULL AND symbol IS NOT NULL AND peer <> symbol").select(F.col("symbol").alias("focus"), "peer").distinct()
        pairs = pairs.join(given.select("focus").distinct(), "focus", "left_anti").unionByName(given.withColumn("cohort", F.lit("supplied")))
    pairs = pairs.where("peer <> focus").withColumn("k", F.row_number().over(Window.partitionBy("focus").orderBy("peer"))).where(F.col("k") <= cap).drop("k")
    selves = pairs.select("focus", F.col("focus").alias("peer"), "cohort").distinct()
    return pairs.unionByName(selves).withColumnRenamed("peer", "symbol")


def metric_percentiles(sets: DataFrame, metrics: DataFrame, least: int = LEAST, gated: tuple = ("value",)) -> DataFrame:
    """(focus, symbol, cohort, metric, kind, value, peer_n, state, pct): ``metrics`` is (symbol,
    metric, kind, value). Of multiples (kind 'value') what isn't positive is not meaningful
    (state 'NM') and cheaper counts higher; of ``gated`` kinds fewer than ``least`` values in
    a set are 'insufficient-peers'; else the percentile is of those below over n - 1, and null with
    fewer than two values. Nulls and not-a-numbers are missing."""
    m = metrics.withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))
    m = m.withColumn("nm", (F.col("kind") == "value") & F.coalesce(F.col("value") <= 0, F.lit(False))).withColumn("value", F.when(~F.col("nm"), F.col("value")))
    r = sets.join(m, "symbol")
    pool = Window.partitionBy("focus", "metric")
    n = F.count("value").over(pool)
    below = F.rank().over(pool.orderBy(F.asc_nulls_last("value"))) - 1
    r = r.withColumns({"peer_n": n, "below": below})
    few = F.col("kind").isin(*gated) & (F.col("peer_n") < least)
    share = F.try_divide(100.0 * F.col("below"), F.col("peer_n") - 1)
    pct = F.when(F.col("value").isNotNull() & ~few & (F.col("peer_n") >= 2), F.when(F.col("kind") == "value", 100 - share).otherwise(share))
    state = F.when(F.col("nm"), "NM").when(few, "insufficient-peers").when(F.col("value").isNull(), "missing").otherwise("ok")
    return r.select("focus", "symbol", "cohort", "metric", "kind", "value", "peer_n", state.alias("state"), pct.alias("pct"))


def table(percentiles: DataFrame) -> DataFrame:
    """(focus, symbol, cohort, n_metrics, valuation_pct, growth_pct, momentum_pct, value_score,
    quadrant): means of the percentiles a row has; the score is the mean of the three; cheap
    is a valuation of 50 or more, strengthening a positive momentum."""
    of = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("pct")))
    g = percentiles.groupBy("focus", "symbol", "cohort").agg(F.count("pct").alias("n_metrics"), of("value").alias("valuation_pct"), of("growth").alias("growth_pct"), of("momentum").alias("momentum_pct"), F.max(F.when(F.col("kind") == "momentum", F.col("value"))).alias("mom"))
    parts = F.array_compact(F.array("valuation_pct", "growth_pct", "momentum_pct"))
    score = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    cheap, strong = F.col("valuation_pct") >= 50, F.col("mom") > 0
    label = F.when(F.col("valuation_pct").isNotNull() & F.col("mom").isNotNull(), F.concat(F.when(cheap, "Cheap").otherwise("Rich"), F.lit(" & "), F.when(strong, "Strengthening").otherwise("Weakening")))
    r = lambda c: F.round(c, 6)
    return g.select("focus", "symbol", "cohort", "n_metrics", *[r(F.col(k)).alias(k) for k in ("valuation_pct", "growth_pct", "momentum_pct")], r(score).alias("value_score"), label.alias("quadrant"))


#: Of the value score: fixed values.
WEIGHTS = (("value", 0.5), ("growth", 0.25), ("momentum", 0.25))


def value_scores(percentiles: DataFrame) -> DataFrame:
    """(focus, symbol, cheapness, growth, momentum, value_score, coverage, low_coverage): the
    weighted mean of the components a row has, each the mean of its percentiles; coverage is
    the share of its metrics with a usable value, and low under a half."""
    of = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("pct")))
    g = percentiles.groupBy("focus", "symbol").agg(*[of(k).alias(k) for k, _ in WEIGHTS], (F.count("value") / F.count("*")).alias("coverage"))
    total = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in WEIGHTS[1:]), F.coalesce(F.col(WEIGHTS[0][0]) * WEIGHTS[0][1], F.lit(0.0)))
    held = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS[1:]), F.when(F.col(WEIGHTS[0][0]).isNotNull(), WEIGHTS[0][1]).otherwise(0.0))
    r = lambda c: F.round(c, 6)
    return g.select("focus", "symbol", r(F.col("value")).alias("cheapness"), r(F.col("growth")).alias("growth"), r(F.col("momentum")).alias("momentum"), r(F.when(held > 0, total / held)).alias("value_score"), r(F.col("coverage")).alias("coverage"), (F.col("coverage") < 0.5).alias("low_coverage"))
