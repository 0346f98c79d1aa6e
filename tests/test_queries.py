"""Every registered query against its SQL in DuckDB; the rest must give rows."""

import pytest

from panelspark import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(name, spark):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
