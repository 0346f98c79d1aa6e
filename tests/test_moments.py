"""Moments of moving frames against Spark's own, over frames before, around and after a row."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import rolling as R

FRAMES = ((-4, 0), (-6, -2), (-1, 3), (1, 3))
ONE, TWO = ("count", "sum", "avg", "stddev_samp", "var_samp", "var_pop", "stddev_pop"), ("covar_pop", "covar_samp")


def rows_of(spark):
    rows = [(f"s{s}", f"2020-01-{d:02d}", None if (s + d) % 5 == 0 else float((s * 7 + d * d * 3) % 11) * 10.0 ** (s - 2), None if d % 7 == 3 else float(d * s % 6)) for s in range(5) for d in range(1, 2 + s * 6)]
    return spark.createDataFrame(rows, "symbol string, trade_date string, x double, y double").withColumn("trade_date", F.to_date("trade_date"))


def test_moments_are_sparks_own(spark):
    df = rows_of(spark)
    specs = {f"{k}_{i}": (k, "x", lo, hi, 1) for i, (lo, hi) in enumerate(FRAMES) for k in ONE} | {f"{k}_{i}": (k, ("x", "y"), lo, hi, 1) for i, (lo, hi) in enumerate(FRAMES) for k in TWO}
    specs |= {f"quantile_{i}": ("quantile", "x", lo, hi, 1, 0.3) for i, (lo, hi) in enumerate(FRAMES)}
    w = Window.partitionBy("symbol").orderBy("trade_date")
    own = df.withColumns({f"quantile_{i}": R.quantile(R.sorted_frame("x", w.rowsBetween(lo, hi)), 0.3) for i, (lo, hi) in enumerate(FRAMES)})
    for i, (lo, hi) in enumerate(FRAMES):
        own = own.withColumns({f"{k}_{i}": getattr(F, k)("x").over(w.rowsBetween(lo, hi)) for k in ONE} | {f"{k}_{i}": getattr(F, k)("x", "y").over(w.rowsBetween(lo, hi)) for k in TWO})
    key = lambda r: (r["symbol"], r["trade_date"])
    want = sorted(own.collect(), key=key)
    for chunk in (3, 1 << 16):
        got = sorted(R.moments(df, chunk, **specs).collect(), key=key)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            for c in specs:
                assert (a[c] is None) == (b[c] is None), (c, a, b)
                assert a[c] is None or abs(a[c] - b[c]) <= 1e-9 * max(1, abs(b[c])), (c, a, b)


def test_moments_want_their_least_count_and_leave_the_order(spark):
    df = R.in_order(rows_of(spark))
    m = R.moments(df, a=R.over("avg", "x", 5), b=R.over("avg", "x", 5, 2))
    again = R.moments(m, c=R.over("sum", "b", 3))  # a second pass takes the rows as they lie
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-4, 0)
    check = again.withColumn("n", F.count("x").over(w)).select("n", "a", "b").collect()
    assert all((r.a is not None) == (r.n >= 5) and (r.b is not None) == (r.n >= 2) for r in check)


def test_daily_abnormal_moves_no_row_a_day(spark):
    from panelspark.operators import studies

    days = spark.range(1, 80).selectExpr("'a' AS symbol", "date_add(DATE'2020-01-01', int(id)) AS trade_date", "double(id % 5) AS ret", "double(id % 3) AS bench_ret", "int(id) AS sess")
    at = days.where("sess IN (30, 41)").selectExpr("symbol", "'E' AS event_type", "trade_date AS event_date", "false AS after_close", "0.5D AS alpha", "2.0D AS beta", "trade_date AS session")
    out = studies.daily_abnormal(at, days)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.event_date, r.day, r.trade_date, r.abnormal, r.cumulative) for r in out.collect())
    known = {r.sess: r for r in days.collect()}
    want = []
    for s in (30, 41):
        total = 0.0
        for k in range(-10, 31):
            x = known[s + k].ret - 0.5 - 2 * known[s + k].bench_ret
            total += x
            want.append((known[s].trade_date, k, known[s + k].trade_date, x, total))
    assert got == sorted(want)


def test_newest_tail_risk_is_the_last_rows(spark):
    b = rows_of(spark).selectExpr("symbol", "trade_date", "abs(coalesce(x, 2.5)) + 1 AS close")
    key = lambda df: sorted(map(tuple, df.collect()))
    last = R.latest(R.tail_risk(b, 6), 1).drop("age")
    new = R.tail_risk(b, 6, newest=True)
    assert key(new) == key(last) and "collect_list" in new._jdf.queryExecution().optimizedPlan().toString()
