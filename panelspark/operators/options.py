"""Option-chain analytics: every chain in one job, greeks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.normal import bound, cdf, pdf

RATE = 0.045


def clean(chain: DataFrame) -> DataFrame:
    """Casts are done. A volatility that is missing or out of [0.05, 4] is repaired: by
    inversion of the last price, if that is over 0.01 and gives one in [0.05, 3.5]; else by
    the median of its expiry's sound ones ([0.05, 3.5]), else of the chain's, else 0.2. Rows
    without open interest and volume go; of the rest those with a bid are kept alone unless
    they are under a quarter."""
    sound = F.when(F.col("iv").between(0.05, 3.5), F.col("iv"))
    bad = F.col("iv").isNull() | ~F.col("iv").between(0.05, 4.0)
    by = Window.partitionBy("underlying")
    c = chain.withColumn("sound", sound)
    c = c.withColumns({"m1": F.percentile("sound", 0.5).over(Window.partitionBy("underlying", "dte")), "m2": F.percentile("sound", 0.5).over(by)})
    found = implied_vol(F.col("last"), F.col("spot"), F.col("strike"), F.greatest(F.col("dte"), F.lit(1)) / 365.0, F.col("cp") == "C")
    c = c.withColumn("found", F.when(bad & (F.col("last") > 0.01), found))
    repaired = F.coalesce(F.when(F.col("found").between(0.05, 3.5), F.col("found")), "m1", "m2", F.lit(0.2))
    c = c.withColumn("iv", F.when(bad, repaired).otherwise(F.col("iv")))
    c = c.where("strike > 0 AND dte >= 0 AND (oi > 0 OR volume > 0)")
    c = c.withColumns({"nq": F.count_if(F.col("bid") > 0).over(by), "nu": F.count("*").over(by)})
    return c.where((4 * F.col("nq") < F.col("nu")) | (F.col("bid") > 0)).drop("sound", "m1", "m2", "found", "nq", "nu")


def hedge_weight() -> Column:
    """Open interest, or volume where that is greater."""
    return F.greatest("volume", "oi")


def dealer_sign(convention: str = "naive") -> Column:
    """naive: long calls, short puts. short_wings: short what is out of the money."""
    if convention == "naive":
        return F.when(F.col("cp") == "C", 1).otherwise(-1)
    out = ((F.col("cp") == "P") & (F.col("strike") < F.col("spot"))) | ((F.col("cp") == "C") & (F.col("strike") > F.col("spot")))
    return F.when(out, -1).otherwise(1)


def with_greeks(chain: DataFrame, rate: float = RATE) -> DataFrame:
    """Adds t, d1, d2, delta, gamma, vega, theta (a day), vanna, charm (a day), price."""
    s, k, v = F.col("spot"), F.col("strike"), F.col("iv")
    c = chain.withColumn("t", F.greatest(F.col("dte"), F.lit(1)) / 365.0)
    t = F.col("t")
    c = c.withColumn("d1", (F.ln(s / k) + (rate + v * v / 2) * t) / (v * F.sqrt(t)))
    c = c.withColumn("d2", F.col("d1") - v * F.sqrt(t))
    call, disc = F.col("cp") == "C", k * F.exp(-rate * t)
    n1, n2, p1 = cdf(F.col("d1")), cdf(F.col("d2")), pdf(F.col("d1"))
    c = c.withColumns({"n1": n1, "n2": n2, "p1": p1})
    side = lambda a, b: F.when(call, a).otherwise(b)
    return c.withColumns({
        "delta": side(F.col("n1"), F.col("n1") - 1), "gamma": F.col("p1") / (s * v * F.sqrt(t)), "vega": s * F.col("p1") * F.sqrt(t) / 100,
        "theta": (-s * F.col("p1") * v / (2 * F.sqrt(t)) + side(-rate * disc * F.col("n2"), rate * disc * (1 - F.col("n2")))) / 365,
        "vanna": -F.col("p1") * F.col("d2") / v, "charm": -F.col("p1") * (2 * rate * t - F.col("d2") * v * F.sqrt(t)) / (2 * t * v * F.sqrt(t)) / 365,
        "price": side(s * F.col("n1") - disc * F.col("n2"), disc * (1 - F.col("n2")) - s * (1 - F.col("n1"))),
    }).drop("n1", "n2", "p1")


def gex_by_strike(chain: DataFrame) -> DataFrame:
    """Dollar gamma, vanna and charm by strike; weight is the greater of volume and open
    interest, calls count up and puts down."""
    g = with_greeks(chain)
    w = hedge_weight() * 100
    sign = dealer_sign()
    gex = F.col("gamma") * w * F.col("spot") * F.col("spot") * 0.01
    only = lambda cp, c: F.sum(F.when(F.col("cp") == cp, c).otherwise(0.0))
    return g.groupBy("underlying", "strike", "spot").agg(
        F.sum(sign * gex).alias("net"), only("C", gex).alias("call"), only("P", gex).alias("put"), F.sum(sign * F.col("vanna") * w * F.col("spot")).alias("vanna"), F.sum(sign * F.col("charm") * w * F.col("spot")).alias("charm"),
    )


def levels(by_strike: DataFrame) -> DataFrame:
    """Call wall (most call gamma at or above spot), put wall (most put gamma at or below),
    the strike of the largest net, and total net."""
    up, down = F.col("strike") >= F.col("spot"), F.col("strike") <= F.col("spot")
    return by_strike.groupBy("underlying").agg(
        F.max_by(F.when(up, F.col("strike")), F.when(up, F.struct(F.round("call", 4), -F.col("strike")))).alias("call_wall"), F.max_by(F.when(down, F.col("strike")), F.when(down, F.struct(F.round("put", 4), F.col("strike")))).alias("put_wall"),
        F.max_by("strike", F.struct(F.round(F.abs("net"), 4), "strike")).alias("hvl"), F.round(F.sum("net"), 4).alias("total"),
    )


def atm(chain: DataFrame, within: float = 0.05) -> DataFrame:
    """The contract nearest to spot of each chain, expiry and side, within 5 % of it."""
    gap = F.abs(F.col("strike") - F.col("spot"))
    ok = chain.where((gap <= within * F.col("spot")) & (F.col("iv") > 0.01) & (F.col("iv") <= 5))
    return ok.groupBy("underlying", "dte", "cp").agg(F.min_by(F.struct("strike", "iv", "last", "contract"), F.struct(gap, "strike", "contract")).alias("x")).select("underlying", "dte", "cp", "x.*")


def implied_vol(price: Column, spot: Column, strike: Column, t: Column, call: Column, rate: float = RATE, steps: int = 40) -> Column:
    """Bisection on [0.02, 4] for the volatility that gives ``price``: one fold a row."""

    def value(v: Column) -> Column:
        d1 = (F.ln(spot / strike) + (rate + v * v / 2) * t) / (v * F.sqrt(t))
        c = spot * bound(d1, cdf) - strike * F.exp(-rate * t) * bound(d1 - v * F.sqrt(t), cdf)
        return bound(c, lambda c: F.when(call, c).otherwise(c - spot + strike * F.exp(-rate * t)))

    def step(acc: Column, _: Column) -> Column:
        half = lambda mid: bound(value(mid) > price, lambda high: F.struct(F.when(high, acc["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(acc["hi"]).alias("hi")))
        return bound((acc["lo"] + acc["hi"]) / 2, half)

    start = F.struct(F.lit(0.02).alias("lo"), F.lit(4.0).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.when((found > 0.0201) & (found < 3.999), found)


def gamma_flip(chain: DataFrame, points: int = 201, width: float = 0.3) -> DataFrame:
    """The spot, of a grid within 30 %, where net gamma changes sign, interpolated, nearest
    to spot. The grid multiplies rows by its points and stays dealt by chain."""
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    c = chain.withColumns({"spot0": F.col("spot"), "i": F.explode(grid)})
    c = c.withColumn("spot", F.col("spot0") * (1 - width + 2 * width * F.col("i") / (points - 1)))
    t = F.greatest(F.col("dte"), F.lit(1)) / 365.0
    v = F.col("iv")
    d1 = (F.ln(F.col("spot") / F.col("strike")) + (RATE + v * v / 2) * t) / (v * F.sqrt(t))
    sign = F.when(F.col("cp") == "C", 1).otherwise(-1)
    net = F.sum(sign * pdf(d1) * F.col("spot") / (v * F.sqrt(t)) * F.greatest("volume", "oi"))
    g = c.groupBy("underlying", "i", "spot", "spot0").agg(net.alias("net"))
    w = Window.partitionBy("underlying").orderBy("i")
    g = g.withColumns({"net1": F.lead("net").over(w), "spot1": F.lead("spot").over(w)}).where("net * net1 < 0")
    x = F.col("spot") - F.col("net") * (F.col("spot1") - F.col("spot")) / (F.col("net1") - F.col("net"))
    return g.groupBy("underlying").agg(F.min_by(x, F.struct(F.round(F.abs(x - F.col("spot0")), 6), "i")).alias("flip")).select("underlying", F.round("flip", 6).alias("flip"))
