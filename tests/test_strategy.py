"""The composite strategy moves only what it needs, in one pass over a symbol."""

from pyspark.sql import functions as F

from panelspark import registry  # noqa: F401  plans import each other through it
from panelspark.operators import rolling as R
from panelspark.plans.risk import strategy
from panelspark.sources.views import bars
from tests.conftest import SMALL


def test_strategy_takes_one_narrow_pass(spark):
    plan = strategy(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    passes = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(passes) == 1 and not any(c in passes[0] for c in ("open#", "high#", "low#", "volume#", "log_ret#", "rsi_2"))
    assert "min_by" not in plan and "SortAggregate" not in plan  # opens and ranges aren't made


def test_narrow_composite_is_the_whole_one(spark):
    b = bars(spark, SMALL)
    cols = ["symbol", "trade_date", "ret", "rn", "score", "v20", "median_ret"]
    rows = lambda df: sorted(map(tuple, df.select(cols).collect()), key=repr)
    narrow = R.composite(b, keep=("rn",))
    assert rows(narrow) == rows(R.composite(b)) and "high" not in narrow.columns and "rn" in narrow.columns


def test_true_range_still_has_its_columns(spark):
    from panelspark.sources.views import with_returns

    r = R.recursive(with_returns(bars(spark, SMALL)), ("atr_14",))
    assert r.where(F.col("atr_14") > 0).count() > 0
