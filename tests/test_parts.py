"""Operators of ``plans/parts.py`` whose values SQL can't give: repair of volatilities, quantiles."""

from statistics import NormalDist

from pyspark.sql import functions as F

from panelspark.functions.normal import cdf, quantile
from panelspark.operators import options as O

CHAIN = "contract int, underlying string, spot double, strike double, dte int, cp string, iv double, oi int, volume int, last double, bid double, ask double"


def test_volatilities_are_repaired_in_order(spark):
    spot, strike, t, rate, v = 100.0, 105.0, 30 / 365.0, O.RATE, 0.37
    one = spark.createDataFrame([(1, "A", spot, strike, 30, "C", v, 1, 1, 0.0, 1.0, 2.0)], CHAIN)
    price = O.with_greeks(one).select("price").first()[0]
    rows = [
        (1, "A", spot, strike, 30, "C", None, 1, 1, price, 1.0, 2.0),  # inverted
        (2, "A", spot, strike, 30, "C", 9.0, 1, 1, 0.005, 1.0, 2.0),  # the expiry's median
        (3, "A", spot, 90.0, 30, "P", 0.2, 1, 1, 1.0, 1.0, 2.0),
        (4, "A", spot, 95.0, 30, "P", 0.4, 1, 1, 1.0, 1.0, 2.0),
        (5, "A", spot, 95.0, 60, "P", 0.01, 1, 1, 0.0, 1.0, 2.0),  # the chain's
        (6, "A", spot, 95.0, 60, "P", 3.8, 1, 1, 0.0, 1.0, 2.0),  # kept, but in no median
        (7, "A", spot, 95.0, 60, "P", 0.3, 0, 0, 0.0, 1.0, 2.0),  # untraded: goes, but in the medians
        (8, "A", spot, 95.0, 90, "P", 0.3, 1, 1, 0.0, 0.0, 2.0),  # without a bid: goes
        (9, "B", spot, 95.0, 90, "P", None, 1, 1, None, 0.0, 2.0),  # no bid in the chain: stays; nothing known
    ]
    got = {r[0]: round(r[1], 6) for r in O.clean(spark.createDataFrame(rows, CHAIN)).select("contract", "iv").collect()}
    assert got == {1: v, 2: 0.3, 3: 0.2, 4: 0.4, 5: 0.3, 6: 3.8, 9: 0.2}


def test_quantiles_undo_the_distribution(spark):
    p = [1e-12, 0.001, 0.02425, 0.3, 0.5, 0.7, 0.999]
    df = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, None]], "p double").select("p", quantile(F.col("p")).alias("x"))
    got = {r["p"]: r["x"] for r in df.withColumn("again", cdf(F.col("x"))).collect()}
    assert all(abs(got[x] - NormalDist().inv_cdf(x)) < 1e-7 for x in p)
    assert got[0.0] is None and got[1.0] is None and got[None] is None


def test_dealer_signs(spark):
    rows = [("C", 110.0), ("C", 90.0), ("P", 90.0), ("P", 110.0), ("C", 100.0)]
    df = spark.createDataFrame([(c, k, 100.0) for c, k in rows], "cp string, strike double, spot double")
    assert [tuple(r) for r in df.select(O.dealer_sign(), O.dealer_sign("short_wings")).collect()] == [(1, -1), (1, 1), (-1, -1), (-1, 1), (1, 1)]
