"""Last digits: closes whose logarithm lies on a rounding edge."""

import datetime as dt

import duckdb
import pandas as pd

from panelspark import registry


def test_logarithms_are_those_of_the_sql(spark, tmp_path):
    """Java's logarithm of these closes is another by the last bit, and rounds the other way."""
    edge = [(33055268, 50), (40294184, 18), (43043127, 75), (52457005, 3)]
    lines = [(k, 1, s, 1, cents / 100, float(q), pd.Timestamp(2020, 1, 1) + dt.timedelta(days=day)) for s, (cents, q) in enumerate(edge) for day, k in ((0, 2 * s), (1, 2 * s + 1))]
    pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"]).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = dict(c.execute(f"SELECT symbol, log_close FROM ({registry.SQL['f1_math']})").fetchall())
    got = {r.symbol: r.log_close for r in registry.QUERIES["f1_math"](spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got == want
