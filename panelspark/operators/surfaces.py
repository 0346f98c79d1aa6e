"""Smiles, densities and surface grids of option chains, and histories of their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.options import RATE


def replaced(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key by ``at``; of equal times the new one."""
    both = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "__g")).alias("__x")).select(*keys, "__x.*")


def history(snapshots: DataFrame, value: str, n: int = 252) -> DataFrame:
    """(symbol, now, n, below, low, high, all): the latest ``n`` snapshots that have the
    value, against the newest of them; ``all`` in order of value."""
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    s = snapshots.where(F.col(value).isNotNull()).withColumn("age", age).where(F.col("age") <= n)
    g = s.groupBy("symbol").agg(F.max(F.when(F.col("age") == 1, F.col(value))).alias("now"), F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sort_array(F.collect_list(value)).alias("all"))
    return g.withColumn("below", F.size(F.filter("all", lambda x: x < F.col("now"))))


def svi_fit(wings: DataFrame, by: list[str], shifts: int = 13, widths: tuple = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)) -> DataFrame:
    """(by, n, a, b, rho, m, sigma, rmse, fitted, arbitrage_free) of rows (k, w): raw SVI
    w = a + b (rho (k - m) + sqrt((k - m)^2 + sigma^2)). Over a grid of m and sigma the rest
    is linear: three sums of squares a grid point, in one grouped pass; the best point that
    keeps b and |rho| in bounds is taken. Butterflies are checked by Durrleman's function
    on 100 points. Fewer than five rows, or none in bounds: not fitted."""
    span = wings.where("w > 0").withColumns({"lo": F.min("k").over(Window.partitionBy(*by)), "hi": F.max("k").over(Window.partitionBy(*by))})
    grid = F.array(*[F.struct(F.lit(i / (shifts - 1)).alias("f"), F.lit(s).alias("sigma")) for i in range(shifts) for s in widths])
    g = span.withColumn("g", F.explode(grid)).withColumns({"m": F.col("lo") + F.col("g.f") * (F.col("hi") - F.col("lo")), "sigma": F.col("g.sigma")})
    g = g.withColumn("x", F.col("k") - F.col("m")).withColumn("y", F.sqrt(F.col("x") * F.col("x") + F.col("sigma") * F.col("sigma")))
    g = g.groupBy(*by, "m", "sigma", "lo", "hi").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("w").alias("mw"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.var_pop("w").alias("ww"),
        F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "w").alias("xw"), F.covar_pop("y", "w").alias("yw"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    g = g.withColumns({"c": F.try_divide(F.col("xw") * F.col("yy") - F.col("yw") * F.col("xy"), det), "b": F.try_divide(F.col("yw") * F.col("xx") - F.col("xw") * F.col("xy"), det)})
    g = g.withColumns({"a": F.col("mw") - F.col("c") * F.col("mx") - F.col("b") * F.col("my"), "rho": F.try_divide("c", "b"), "sse": F.greatest(F.lit(0.0), F.col("ww") - F.col("c") * F.col("xw") - F.col("b") * F.col("yw"))})
    ok = F.col("b").between(1e-4, 2.0) & F.col("rho").between(-0.999, 0.999) & (F.col("a") + F.col("b") * F.col("sigma") * F.sqrt(1 - F.col("rho") * F.col("rho")) >= 0) & (F.col("n") >= 5)
    best = g.groupBy(*by).agg(F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by(F.struct("a", "b", "rho", "m", "sigma", "sse"), F.when(ok, F.struct("sse", "sigma", "m"))).alias("x")).select(*by, "n", "lo", "hi", "x.*")
    k = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / 99)

    def durrleman(k: Column) -> Column:
        d = k - F.col("m")
        root = F.sqrt(d * d + F.col("sigma") * F.col("sigma"))
        w, w1, w2 = F.col("a") + F.col("b") * (F.col("rho") * d + root), F.col("b") * (F.col("rho") + d / root), F.col("b") * F.col("sigma") * F.col("sigma") / (root * root * root)
        one = 1 - k * w1 / (2 * w)
        return F.when(w > 0, one * one - w1 * w1 / 4 * (1 / w + 0.25) + w2 / 2).otherwise(-1.0)

    best = best.withColumn("rmse", F.sqrt("sse")).withColumn("fitted", F.coalesce(F.col("rmse") < 0.2, F.lit(False)))
    return best.withColumn("arbitrage_free", F.when(F.col("a").isNotNull(), F.array_min(F.transform(k, durrleman)) >= -1e-4)).drop("lo", "hi", "sse")


def density(calls: DataFrame, by: list[str], rate: float = RATE) -> DataFrame:
    """(by, n, reason, total, up_10, down_10, up_20, down_20) of rows (strike, price, spot,
    t), one a strike: the second difference of call prices, discounted back, as the
    risk-neutral density at the inner strikes, and tail probabilities in per cent by
    trapezoids. Rising prices and negative densities are refused with the reason."""
    w = Window.partitionBy(*by).orderBy("strike")
    c = calls.withColumns({"k0": F.lag("strike").over(w), "c0": F.lag("price").over(w), "k1": F.lead("strike").over(w), "c1": F.lead("price").over(w)})
    bend = 2 * ((F.col("c1") - F.col("price")) / (F.col("k1") - F.col("strike")) - (F.col("price") - F.col("c0")) / (F.col("strike") - F.col("k0"))) / (F.col("k1") - F.col("k0"))
    c = c.withColumns({"bend": bend, "q": F.when(bend.isNotNull(), F.exp(rate * F.col("t")) * F.greatest(bend, F.lit(0.0)))})
    c = c.withColumn("area", F.when(F.lag("q").over(w).isNotNull() & F.col("q").isNotNull(), (F.col("q") + F.lag("q").over(w)) / 2 * (F.col("strike") - F.col("k0"))))
    part = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("area"))), F.lit(0.0))
    # both ends of a trapezoid lie in the tail
    above = lambda x: F.col("k0") >= F.col("spot") * x - 1e-9
    below = lambda x: F.col("strike") <= F.col("spot") * x + 1e-9
    g = c.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or(F.col("c1") - F.col("price") > 1e-4).alias("rises"), F.bool_or(F.col("bend") < -1e-4).alias("bends"), F.sum("area").alias("total"), part(above(1.1)).alias("u1"), part(below(0.9)).alias("d1"), part(above(1.2)).alias("u2"), part(below(0.8)).alias("d2"))
    reason = F.when(F.col("n") < 5, "too few strikes").when(F.col("rises"), "monotonicity").when(F.col("bends"), "butterfly").when(F.coalesce("total", F.lit(0.0)) <= 0, "no mass")
    g = g.withColumn("reason", reason)
    share = lambda x: F.when(F.col("reason").isNull(), F.round(100 * F.col(x) / F.col("total"), 6))
    return g.select(*by, "n", "reason", F.when(F.col("reason").isNull(), F.round("total", 6)).alias("total"), share("u1").alias("up_10"), share("d1").alias("down_10"), share("u2").alias("up_20"), share("d2").alias("down_20"))


def surface_grid(chain: DataFrame, points: int = 21, expiries: int = 8) -> DataFrame:
    """(underlying, dte, moneyness, iv): implied volatility, in per cent, at even moneyness
    from 0.8 to 1.2 of the first expiries, linear between strikes (contracts of one strike
    are averaged) and flat beyond them; null with under three quotes, no rows with under
    two expiries. A strike fills the points up to the next, so no grid is joined."""
    by = Window.partitionBy("underlying")
    c = chain.withColumn("k", F.dense_rank().over(by.orderBy("dte"))).where(F.col("k") <= expiries).withColumn("expiries", F.max("k").over(by)).where("expiries >= 2")
    good = F.col("iv").between(0.01, 3.0)
    c = c.withColumn("quotes", F.count_if(good).over(Window.partitionBy("underlying", "dte")))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: (80 + i * 40 / (points - 1)) / 100)
    none = c.where("quotes < 3").select("underlying", "dte").distinct().select("underlying", "dte", F.explode(grid).alias("moneyness"), F.lit(None).cast("double").alias("iv"))
    s = c.where(good & (F.col("quotes") >= 3)).groupBy("underlying", "dte", (F.col("strike") / F.col("spot")).alias("m")).agg((100 * F.avg("iv")).alias("v"))
    w = Window.partitionBy("underlying", "dte").orderBy("m")
    s = s.withColumns({"m0": F.lag("m").over(w), "m1": F.lead("m").over(w), "v1": F.lead("v").over(w)})
    mine = F.filter(grid, lambda g: ((g >= F.col("m")) | F.col("m0").isNull()) & ((g < F.col("m1")) | F.col("m1").isNull()))
    s = s.withColumn("moneyness", F.explode(mine))
    g = F.col("moneyness")
    iv = F.when((g <= F.col("m")) | F.col("m1").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (g - F.col("m")) / (F.col("m1") - F.col("m")))
    return s.select("underlying", "dte", F.round(g, 2).alias("moneyness"), F.round(iv, 6).alias("iv")).unionByName(none.withColumn("moneyness", F.round("moneyness", 2)))
