import math
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.8g}")
    if hasattr(v, "hour"):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(f, sql):
        df = f(spark, SMALL)
        cols = sorted(df.columns)
        got = sorted((tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
        r = duck.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
        assert got == want

    return check
