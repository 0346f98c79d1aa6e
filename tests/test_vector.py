"""The metric vector to its last digit, where sums of doubles hang on their order."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelspark import registry
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def cheap(tmp_path_factory):
    """Symbols of a few cents: their returns and illiquidities are so great that the last
    bits of a sum show. Some are short, and one never moves."""
    d = tmp_path_factory.mktemp("cheap")
    rng = np.random.default_rng(11)
    sizes = [1, 2, 3, 22, 23, 63, 64, 252, 253, 254] + [400] * 30
    n = sum(sizes)
    k = np.repeat(np.arange(len(sizes)), sizes)
    cents = np.where(k == 8, 7, rng.integers(1, 400, n))
    day = np.concatenate([np.sort(rng.permutation(450)[:s]) for s in sizes])
    lines = pd.DataFrame({"l_orderkey": np.arange(n), "l_partkey": 1, "l_suppkey": k, "l_linenumber": 1, "l_quantity": 1.0, "l_extendedprice": cents / 100, "l_shipdate": [dt.datetime(2020, 1, 1) + dt.timedelta(int(x)) for x in day]})
    lines["l_shipdate"] = lines["l_shipdate"].astype("datetime64[us]")
    lines.sample(frac=1, random_state=3).to_parquet(d / "lineitem.parquet", index=False)
    pd.DataFrame({"s_suppkey": np.arange(len(sizes))}).to_parquet(d / "supplier.parquet", index=False)
    c = duckdb.connect()
    c.execute("SET threads = 1")  # more threads split a symbol's sum as they come
    for t in ("region", "nation"):
        c.execute(f"COPY (FROM '{SMALL}/{t}.parquet') TO '{d}/{t}.parquet'")
    for t in ("region", "nation", "supplier", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["a33_metric_vector", "a13_distributions"])
def test_last_digits(spark, cheap, name):
    d, c = cheap
    df = registry.QUERIES[name](spark, d)
    got = {tuple(r[:2]): tuple(r) for r in df.collect()}
    r = c.execute(registry.SQL[name])
    assert [x[0] for x in r.description] == df.columns
    want = {x[:2]: tuple(x) for x in r.fetchall()}
    assert len(got) == len(want) > 30 and got == want
