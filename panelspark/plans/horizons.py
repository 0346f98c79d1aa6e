"""Registered queries: calendar changes of all horizons, exits at several participation rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import horizons as H
from panelspark.operators import rolling as R
from panelspark.plans import cross_sections
from panelspark.registry import SQL, query
from panelspark.sources.views import bars, sql

_CASES = ", ".join(f"('{k}', {n if unit == 'd' else 0}, {n if unit == 'm' else 0})" for k, unit, n in H.HORIZONS) + ", ('YTD', 0, 0)"
CHANGES = f"""h(period, dd, mm) AS (VALUES {_CASES}), la AS (SELECT symbol, max(trade_date) AS l, arg_max(close, trade_date) AS now FROM bars GROUP BY symbol),
a AS (SELECT symbol, now, period, CASE WHEN period = 'YTD' THEN date_trunc('year', l)::DATE ELSE (l - to_days(dd) - to_months(mm))::DATE END AS target FROM la, h),
b1 AS (SELECT a.*, b.trade_date AS d1, b.close AS c1 FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.target >= b.trade_date), b2 AS (SELECT b1.*, f.trade_date AS d2, f.close AS c2 FROM b1 ASOF LEFT JOIN bars f ON b1.symbol = f.symbol AND b1.target <= f.trade_date),
p AS (SELECT *, d1 IS NOT NULL AND (d2 IS NULL OR target - d1 <= d2 - target) AS back FROM b2), m AS (SELECT symbol, period, target, now, CASE WHEN back THEN CASE WHEN target - d1 <= {H.WITHIN} THEN d1 END WHEN d2 - target <= {H.WITHIN} THEN d2 END AS matched, CASE WHEN back THEN c1 ELSE c2 END AS c FROM p)"""


@query("w7_calendar_changes", sql("bars", ctes=CHANGES, body="SELECT symbol, period, target, matched, round(CASE WHEN matched IS NOT NULL THEN c END, 6) AS price_then, round(CASE WHEN matched IS NOT NULL THEN (now / c - 1) * 100 END, 6) AS change_pct FROM m"))
def w7(spark, d) -> DataFrame:
    return R.tidy(H.calendar_changes(bars(spark, d)), "symbol", "period", "target", "matched", price_then=F.col("price_then"), change_pct=F.col("change_pct"))


@query("a29_exit_costs", sql("bars", ctes=f"x AS (SELECT *, close * volume AS dv, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS age FROM bars), g AS (SELECT symbol, avg(dv) FILTER (age <= 20) AS a20, avg(dv) FILTER (age <= 60) AS a60, avg(volume) FILTER (age <= 20) AS s20, avg(volume) FILTER (age <= 60) AS s60 FROM x GROUP BY symbol HAVING count(*) >= 5), s AS ({SQL['a31_corwin_schultz']})", body="SELECT symbol, round(a20, 4) AS adv_20, round(a60, 4) AS adv_60, round(s20, 4) AS adv_20_shares, round(s60, 4) AS adv_60_shares, round(1e5::DOUBLE / (a20 * 0.01::DOUBLE), 4) AS days_to_exit_1pct, round(1e5::DOUBLE / (a20 * 0.05::DOUBLE), 4) AS days_to_exit_5pct, round(spread / 2 * 1e5::DOUBLE, 4) AS half_spread_cost, 1e5::DOUBLE / (a20 * 0.05::DOUBLE) > 5 OR a20 < 1e6 AS illiquid, CASE WHEN 1e5::DOUBLE / (a20 * 0.05::DOUBLE) > 5 THEN 'slow exit' WHEN a20 < 1e6 THEN 'thin trading' END AS warning FROM g LEFT JOIN s USING (symbol)"))
def a29(spark, d) -> DataFrame:
    """The spread is that of the high and low prices of two days."""
    c = H.exit_costs(bars(spark, d), cross_sections.a31(spark, d))
    return R.tidy(c, "symbol", "illiquid", "warning", digits=4, **{k: F.col(k) for k in c.columns if k not in ("symbol", "illiquid", "warning")})
