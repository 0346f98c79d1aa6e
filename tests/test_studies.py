"""Events are looked up where their symbol's moments are made: odd events, and what is moved."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark import registry
from panelspark.operators import rolling as R
from panelspark.operators import studies
from panelspark.operators.asof import asof
from tests.conftest import SMALL

DAY = dt.date(2020, 1, 1)
EVENTS = "symbol string, event_type string, event_date date, after_close boolean"


def sessions(spark):
    """Two symbols on every second day, one of them with fewer; one more without events."""
    d = spark.range(90).selectExpr("explode(array('a', 'b', 'c')) AS symbol", "int(id) AS id").where("symbol <> 'b' OR id < 40")
    return d.selectExpr("symbol", "date_add(DATE'2020-01-01', 2 * id) AS trade_date", "double(id * 7 % 11) / 100 AS ret", "double(id * 5 % 13) / 100 AS bench_ret").withColumn("sess", F.row_number().over(R.by_symbol()))


def test_odd_events(spark):
    """Between sessions, on one, before the first, after the last, without a date, of no symbol with bars."""
    days = (-9, -1, 0, 20, 21, 40, 61, 77, 78, 79, 150, 178, 190)
    rows = [(s, f"e{d}", DAY + dt.timedelta(d), late) for s in ("a", "b", "x") for d in days for late in (False, True)]
    events = spark.createDataFrame([*rows, ("a", "none", None, True), ("a", "none", None, False), ("a", "when", DAY, None), (None, "who", DAY, False)], EVENTS)
    s, window = sessions(spark), (-2, 3)
    got = studies.event_study(events, s, (-8, -3), window, (1, 2), days=True).cache()
    m = s.select("symbol", "trade_date", "ret", "bench_ret", "sess")
    on = asof(events.where("NOT after_close"), "event_date", m, "trade_date", ["symbol"], ["trade_date", "sess"])
    late = asof(events.where("after_close"), "event_date", m, "trade_date", ["symbol"], ["trade_date", "sess"], forward=True, strict=True)
    size = m.groupBy("symbol").agg(F.max("sess").alias("size"))
    want = on.unionByName(late).where("event_date IS NOT NULL AND sess IS NOT NULL").join(size, "symbol").where("sess > 8 AND sess + 3 <= size")
    place = lambda df, day: sorted((r.symbol, r.event_date, r.after_close, r[day]) for r in df.collect())
    assert place(got, "session") == place(want, "trade_date") and 20 < got.count() < 40
    line = lambda df: sorted(map(tuple, df.collect()))
    assert line(studies.abnormal_days(got)) == line(studies.daily_abnormal(got, s, window)) and {r.day for r in studies.abnormal_days(got).collect()} == set(range(-2, 4))
    assert studies.event_study(events.limit(0), s).count() == 0


def test_rows_out_of_order_are_refused(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 1.0), ("a", 2, 1.0)], "symbol string, __k int, x double").coalesce(1)
    with pytest.raises(Exception, match="not in order"):
        R.moments(rows, s=R.over("sum", "x", 2)).collect()


@pytest.mark.parametrize("name, most", [("es1_event_study", 2), ("es1_daily_abnormal", 2), ("w30_event_metrics", 3)])
def test_a_bar_is_moved_once(spark, name, most):
    """Lines and events go to their symbol (and the prints' sums to theirs before); neither moments nor metrics move."""
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= most and plan.count("Exchange hashpartitioning(trade_date") <= 1
