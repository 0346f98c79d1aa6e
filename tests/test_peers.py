"""Peer sets, percentiles, scores and quadrants by hand."""

from panelspark.operators import peers


def sets(spark, rows, given=(), cap=8):
    m = spark.createDataFrame(rows, "symbol string, sector string, industry string")
    g = spark.createDataFrame(list(given), "symbol string, peer string") if given else None
    out = {}
    for r in peers.peer_sets(m, g, cap).collect():
        out.setdefault((r.focus, r.cohort), []).append(r.symbol)
    return {k: "".join(sorted(v)) for k, v in out.items()}


def test_sets(spark):
    rows = [("a", "t", "x"), ("b", "t", "x"), ("c", "t", "x"), ("d", "t", None), ("e", None, None), ("f", "u", "y")]
    assert sets(spark, rows) == {("a", "industry"): "abc", ("b", "industry"): "abc", ("c", "industry"): "abc", ("d", "sector"): "abcd"}
    assert sets(spark, rows, cap=1) == {("a", "industry"): "ab", ("b", "industry"): "ab", ("c", "industry"): "ac", ("d", "sector"): "ad"}
    given = sets(spark, rows, [("a", "f"), ("a", "a"), ("a", "f"), ("e", "b"), ("b", None)])
    assert given[("a", "supplied")] == "af" and given[("e", "supplied")] == "be" and ("a", "industry") not in given and ("b", "industry") in given


def test_percentiles_and_table(spark):
    s = spark.createDataFrame([("a", x, "industry") for x in "abcdef"], "focus string, symbol string, cohort string")
    pe = dict(zip("abcdef", (10.0, 20.0, 30.0, 40.0, 50.0, -5.0)))
    growth = dict(zip("abcdef", (0.1, 0.1, 0.3, None, float("nan"), -0.2)))
    mom = dict(zip("abcdef", (0.5, -0.5, 0.0, None, 0.1, 0.2)))
    rows = [(k, n, kind, x) for n, kind, vs in (("pe", "value", pe), ("growth", "growth", growth), ("mom", "momentum", mom)) for k, x in vs.items()] + [(k, "rare", "value", 1.0) for k in "ab"]
    p = peers.metric_percentiles(s, spark.createDataFrame(rows, "symbol string, metric string, kind string, value double")).collect()
    got = {(r.symbol, r.metric): (r.state, r.pct, r.peer_n) for r in p}
    assert [got[k, "pe"][1] for k in "abcde"] == [100.0, 75.0, 50.0, 25.0, 0.0] and got["f", "pe"] == ("NM", None, 5)
    assert got["a", "rare"] == ("insufficient-peers", None, 2)
    third = 100 / 3
    assert [got[k, "growth"][1] for k in "abcf"] == [third, third, 100.0, 0.0] and got["d", "growth"][0] == got["e", "growth"][0] == "missing"
    t = {r.symbol: r for r in peers.table(spark.createDataFrame(p)).collect()}
    assert t["a"].quadrant == "Cheap & Strengthening" and t["b"].quadrant == "Cheap & Weakening" and t["e"].quadrant == "Rich & Strengthening" and t["c"].quadrant == "Cheap & Weakening"
    assert t["d"].quadrant is None and t["d"].value_score == 25.0 and t["f"].valuation_pct is None
    assert t["a"].value_score == round((100 + third + 100) / 3, 6)


def test_value_scores(spark):
    rows = [("s", "a", "pe", "value", 5.0, 80.0), ("s", "a", "ps", "value", 1.0, 40.0), ("s", "a", "g", "growth", 0.1, 20.0), ("s", "a", "m", "momentum", 0.1, 100.0), ("s", "b", "pe", "value", None, None), ("s", "b", "g", "growth", 0.2, 50.0), ("s", "b", "m", "momentum", None, None), ("s", "c", "pe", "value", None, None)]
    p = spark.createDataFrame(rows, "focus string, symbol string, metric string, kind string, value double, pct double")
    got = {r.symbol: (r.cheapness, r.value_score, r.coverage, r.low_coverage) for r in peers.value_scores(p).collect()}
    assert got == {"a": (60.0, 60.0, 1.0, False), "b": (None, 50.0, 0.333333, True), "c": (None, None, 0.0, True)}
