"""Pairs of symbols: what is moved."""

import pytest

from panelspark import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("name", ["a1_pairwise_correlation", "j1_date_self_join"])
def test_blocks_are_made_once_for_both_sides(spark, name):
    """Lines go to their symbol and symbols to their block, once; the product's other side reads the same."""
    df = registry.QUERIES[name](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert plan.count("REPARTITION_BY_COL") <= 2
