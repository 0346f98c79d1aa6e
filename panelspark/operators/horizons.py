"""Changes over calendar horizons, and what it costs to leave a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.asof import nearest

#: Label, days or months back: fixed values; YTD goes back to the first of January.
HORIZONS = (("1W", "d", 7), ("2W", "d", 14), ("3W", "d", 21), ("1M", "m", 1), ("2M", "m", 2), ("3M", "m", 3), ("6M", "m", 6), ("1Y", "m", 12), ("2Y", "m", 24), ("3Y", "m", 36), ("4Y", "m", 48), ("5Y", "m", 60))
WITHIN = 30


def _target(today: Column) -> Column:
    back = [F.struct(F.lit(k).alias("period"), (F.date_sub(today, n) if unit == "d" else F.add_months(today, -n)).alias("target")) for k, unit, n in HORIZONS]
    return F.array(*back, F.struct(F.lit("YTD").alias("period"), F.trunc(today, "year").alias("target")))


def calendar_changes(bars: DataFrame, today: Column | None = None, within: int = WITHIN) -> DataFrame:
    """(symbol, period, target, matched, price_then, change_pct) for each horizon back from
    ``today`` (a date; each symbol's last bar unless given): the close of the trading day
    nearest to the target, the earlier of two as near; null beyond ``within`` days. A row
    for every symbol and horizon."""
    last = bars.groupBy("symbol").agg(F.max("trade_date").alias("last"), F.max_by("close", "trade_date").alias("now"))
    asked = last.select("symbol", "now", F.inline(_target(today if today is not None else F.col("last"))))
    closes = bars.select("symbol", F.col("trade_date").alias("d"), F.struct("close", F.col("trade_date").alias("matched")).alias("hit"))
    n = nearest(asked, "target", closes, "d", ["symbol"], "hit", within)
    then = F.col("hit.close")
    return n.select("symbol", "period", "target", F.col("hit.matched").alias("matched"), then.alias("price_then"), ((F.try_divide(F.col("now"), then) - 1) * 100).alias("change_pct"))


def exit_costs(bars: DataFrame, spreads: DataFrame | None = None, position: float = 100_000.0, rates: tuple = (0.01, 0.05)) -> DataFrame:
    """(symbol, adv_20, adv_60, adv_20_shares, adv_60_shares, days_to_exit_1pct, ..., half_spread_cost,
    illiquid, warning): mean dollar volumes of the last 20 and 60 rows (of all, if fewer),
    days to sell ``position`` at a share of the former, and half the ``spreads`` (symbol,
    spread as a share) on it. Illiquid: more than five days at the last rate, or under a
    million a day. Symbols of fewer than five bars have no row."""
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))
    r = bars.withColumns({"age": age, "dv": F.col("close") * F.col("volume")})
    mean = lambda c, n: F.avg(F.when(F.col("age") <= n, F.col(c)))
    g = r.groupBy("symbol").agg(F.count("*").alias("n"), mean("dv", 20).alias("adv_20"), mean("dv", 60).alias("adv_60"), mean("volume", 20).alias("adv_20_shares"), mean("volume", 60).alias("adv_60_shares")).where("n >= 5")
    if spreads is not None:
        g = g.join(spreads.select("symbol", "spread"), "symbol", "left")
    else:
        g = g.withColumn("spread", F.lit(None).cast("double"))
    days = {f"days_to_exit_{round(x * 100)}pct": F.when(F.col("adv_20") > 0, position / (F.col("adv_20") * x)) for x in rates}
    g = g.withColumns({**days, "half_spread_cost": F.col("spread") / 2 * position})
    slow = F.coalesce(F.col(list(days)[-1]) > 5, F.lit(False))
    thin = F.col("adv_20") < 1e6
    warning = F.when(slow, "slow exit").when(thin, "thin trading")
    return g.select("symbol", "adv_20", "adv_60", "adv_20_shares", "adv_60_shares", *days, "half_spread_cost", (slow | thin).alias("illiquid"), warning.alias("warning"))
