"""Normal density and distribution as column expressions, and as SQL text.

Spark has no erf; this is the rational form of Hart as given by West (2005), which is
within 1e-15 of the distribution everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational form: fixed values.
TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
ROOT_2PI = 2.5066282746310002


def _poly(c: tuple, x):
    return reduce(lambda acc, k: acc * x + k, c[1:], F.lit(c[0]))


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / ROOT_2PI


def cdf(x: Column) -> Column:
    a = F.abs(x)
    tail = F.exp(-a * a / 2) * F.when(a < 7.07, _poly(TOP, a) / _poly(BOTTOM, a)).otherwise(1 / (ROOT_2PI * (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65)))))))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def bound(x: Column, f) -> Column:
    """``f(x)`` with x computed once: in a fold, an expression repeated in itself grows the
    plan by its size each time."""
    return F.get(F.transform(F.array(x), f), 0)


def quantile(p: Column, steps: int = 60) -> Column:
    """The inverse of ``cdf`` by bisection, one fold a row; exact in the lower tail, from the
    upper one by symmetry. Null outside (0, 1)."""
    low = F.least(p, 1 - p)

    def step(acc: Column, _: Column) -> Column:
        half = lambda mid: bound(cdf(mid) > low, lambda high: F.struct(F.when(high, acc["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(acc["hi"]).alias("hi")))
        return bound((acc["lo"] + acc["hi"]) / 2, half)

    start = F.struct(F.lit(-38.0).alias("lo"), F.lit(0.0).alias("hi"))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: (a["lo"] + a["hi"]) / 2)
    return F.when((p > 0) & (p < 1), F.when(p > 0.5, -x).otherwise(x))


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    poly = lambda c: reduce(lambda acc, k: f"({acc} * {a} + {k!r}::DOUBLE)", c[1:], f"{c[0]!r}::DOUBLE")
    tail = f"(exp(-{a} * {a} / 2) * CASE WHEN {a} < 7.07 THEN {poly(TOP)} / {poly(BOTTOM)} ELSE 1 / ({ROOT_2PI!r}::DOUBLE * ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))) END)"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"
