"""Touches of dated option levels: does the price turn, or swing, where walls and flips are?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.normal import cdf
from panelspark.operators.asof import asof
from panelspark.operators.rolling import tidy
from panelspark.sources.views import by_symbol

KINDS = ("call_wall", "put_wall", "gamma_flip")


def null_levels(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, drawn): n levels a symbol between its lowest close plus 5 % and its highest
    less 5 %, drawn by a hash."""
    ends = bars.groupBy("symbol").agg(F.min("close").alias("lo"), F.max("close").alias("hi"))
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", "symbol", i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    level = lambda i: F.col("lo") * 1.05 + draw(i) * (F.col("hi") * 0.95 - F.col("lo") * 1.05)
    return ends.select("symbol", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), level(i).alias("level"))).alias("drawn"))


def study(bars: DataFrame, levels: DataFrame, nulls: int = 25, tolerance: float = 0.01) -> DataFrame:
    """(symbol, level_type, touches, reversals, rate, baseline, spread, z, p, mean_move,
    significant). ``levels``: (symbol, as_of, call_wall, put_wall, gamma_flip) in prices;
    those of the last snapshot before a bar's date hold on it. A call wall is touched from
    below and a put wall from above, within ``tolerance``, and the price turns if the next
    close goes back; a flip is crossed between two closes, and 'turns' if the next five
    closes spread more than the five before. The baseline is the mean rate of the drawn
    levels that were touched three times or more (those of puts for flips), z is one-sided.
    Only touches become rows: no bar is copied for a level. A bar without a neighbour on
    both sides, and a level that is null, touch nothing; symbols without touches have no
    row."""
    w = by_symbol()
    five = lambda a, b: F.when(F.count("close").over(w.rowsBetween(a, b)) == 5, F.stddev_pop("close").over(w.rowsBetween(a, b)))
    t = bars.select("symbol", "trade_date", "high", "low", "close", F.lag("close").over(w).alias("before"), F.lead("close").over(w).alias("after"), five(-5, -1).alias("calm"), F.when(F.lead("close", 5).over(w).isNotNull(), five(0, 4)).alias("wild"))
    t = asof(t, "trade_date", levels, "as_of", ["symbol"], list(KINDS), strict=True).where("before IS NOT NULL AND after IS NOT NULL")

    def from_below(level: Column) -> Column:
        return (F.col("before") < level) & (F.col("high") >= level * (1 - tolerance))

    def from_above(level: Column) -> Column:
        return (F.col("before") > level) & (F.col("low") <= level * (1 + tolerance))

    back, up = F.col("after") < F.col("close"), F.col("after") > F.col("close")
    move = F.col("after") / F.col("close") - 1
    swing = F.col("wild").isNotNull() & F.col("calm").isNotNull()
    case = lambda kind, hit, turned, size: F.struct(F.lit(kind).alias("level_type"), F.coalesce(hit, F.lit(False)).alias("hit"), F.coalesce(turned, F.lit(False)).alias("turned"), size.alias("move"))
    crossed = (F.col("before") - F.col("gamma_flip")) * (F.col("close") - F.col("gamma_flip")) < 0
    cases = F.array(
        case("call_wall", from_below(F.col("call_wall")), back, move), case("put_wall", from_above(F.col("put_wall")), up, move),
        case("gamma_flip", crossed, swing & (F.col("wild") > F.col("calm")), F.when(swing, (F.col("wild") - F.col("calm")) / F.greatest("calm", F.lit(1e-4)))),
    )
    seen = t.select("symbol", F.inline(F.filter(cases, lambda c: c["hit"])))
    seen = seen.groupBy("symbol", "level_type").agg(F.count("*").alias("touches"), F.count_if("turned").alias("reversals"), F.avg("move").alias("move"))
    drawn = t.join(null_levels(bars, nulls), "symbol")
    met = lambda side, hit, turned: F.transform(F.filter("drawn", lambda x: hit(x["level"])), lambda x: F.struct(F.lit(side).alias("side"), x["i"].alias("i"), turned.alias("turned")))
    rates = drawn.select("symbol", F.inline(F.concat(met("call", from_below, back), met("put", from_above, up)))).groupBy("symbol", "side", "i").agg(F.count("*").alias("n"), F.count_if("turned").alias("k"))
    base = rates.where("n >= 3").withColumn("rate", F.col("k") / F.col("n")).groupBy("symbol", "side").agg(F.avg("rate").alias("baseline"), F.when(F.count("*") > 1, F.stddev_pop("rate")).otherwise(0.08).alias("spread"))
    out = seen.withColumn("side", F.when(F.col("level_type") == "call_wall", "call").otherwise("put")).join(base, ["symbol", "side"], "left")
    out = out.withColumns({"rate": F.col("reversals") / F.col("touches"), "baseline": F.coalesce("baseline", F.lit(0.5)), "spread": F.coalesce("spread", F.lit(0.08))})
    tested = (F.col("touches") >= 3) & (F.col("spread") > 1e-9)
    out = out.withColumn("z", F.when(tested, F.try_divide(F.col("rate") - F.col("baseline"), "spread")).otherwise(0.0)).withColumn("p", F.when(tested, 1 - cdf(F.col("z"))).otherwise(0.5))
    rows = tidy(out, "symbol", "level_type", "touches", "reversals", **{k: F.col(k) for k in ("rate", "baseline", "spread", "z", "p")}, mean_move=F.col("move"))
    return rows.withColumn("significant", (F.col("p") < 0.05) & (F.col("rate") > F.col("baseline")))


def priced(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, as_of, call_wall, put_wall, gamma_flip) in prices of ``levels`` whose walls
    and flips are shares of spot: times the symbol's last close up to the snapshot."""
    closes = asof(levels, "as_of", bars.select("symbol", "trade_date", "close"), "trade_date", ["symbol"], ["close"])
    return closes.where("close IS NOT NULL").select("symbol", "as_of", *[(F.col(k) * F.col("close")).alias(k) for k in KINDS])
