"""Point-in-time joins without a range join: both sides are put on one time line and the
last (or next) row of the other side is carried along, which is linear in the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, time: str, right: DataFrame, right_time: str, by: list[str], values: list[str], forward: bool = False, strict: bool = False, together: bool = False) -> DataFrame:
    """``left`` with ``values`` of the last right row at or before its time (``forward``:
    the first at or after; ``strict``: equal times don't count), null if there is none.
    Of right rows with one time that with the greatest values is taken. ``together``: right
    rows of a key lie in one partition already (after a window by it), so only left ones are moved."""
    left = left.repartition(*by) if together else left
    row, value = F.struct(*left.columns), F.struct(*values)
    a = left.select(*by, F.col(time).alias("__t"), F.lit(1).alias("__s"), row.alias("__row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__v"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(2 if strict else 0).alias("__s"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("__row"), value.alias("__v"))
    t = F.desc("__t") if forward else F.asc("__t")
    w = Window.partitionBy(*by).orderBy(t, "__s", F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__v", F.last("__v", True).over(w)).where("__s = 1")
    return both.select("__row.*", "__v.*")


def nearest(left: DataFrame, time: str, right: DataFrame, right_time: str, by: list[str], value: str, within: int) -> DataFrame:
    """``left`` with the value of the nearest right row in days, the earlier of two as
    near; null beyond ``within`` days."""
    r = right.select(*by, F.col(right_time).alias("__rt"), F.col(value).alias("__rv"))
    back = asof(left, time, r, "__rt", by, ["__rt", "__rv"]).withColumnsRenamed({"__rt": "__t1", "__rv": "__v1"})
    both = asof(back, time, r, "__rt", by, ["__rt", "__rv"], forward=True)
    d1, d2 = F.datediff(time, "__t1"), F.datediff("__rt", time)
    pick = F.when(d1.isNotNull() & (d2.isNull() | (d1 <= d2)), F.when(d1 <= within, F.col("__v1"))).when(d2 <= within, F.col("__rv"))
    gap = F.when(d1.isNotNull() & (d2.isNull() | (d1 <= d2)), d1).otherwise(d2)
    return both.withColumns({value: pick, "gap": F.when(gap <= within, gap)}).drop("__t1", "__v1", "__rt", "__rv")
