"""Publication, retention, history; upserts by part; the ledger."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelspark.sources import store
from panelspark.streaming import jobs

def terms():
    return {"v": F.col("v") < 0}


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int")


def payload(df, *more):
    return sorted(tuple(r) for r in df.select("provider", "snapshot_id", "k", "v", *more).collect())


def test_a_broken_contract_leaves_the_pointer(spark, tmp_path):
    base = str(tmp_path / "s")
    assert store.history(spark, base) is None
    store.publish(frame(spark, ("a", 1)), base, "radar", "d1", terms())
    for bad in (("a", -1), ("a", None)):
        with pytest.raises(store.ContractBroken, match="v: 2 rows"):
            store.publish(frame(spark, ("b", 2), bad), base, "radar", "d2", terms())
    with pytest.raises(store.ContractBroken):
        store.publish(frame(spark, ("a", 1)).limit(0), base, "radar", "d2", terms())
    assert payload(store.history(spark, base, newest=1)) == [("radar", "d1", "a", 1)]
    assert len(list(Path(base, "data", "provider=radar").iterdir())) == 1


def test_three_publications_leave_two_snapshots(spark, tmp_path):
    base = str(tmp_path / "s")
    for i in range(3):
        store.publish(frame(spark, ("a", i)), base, "radar", f"d{i}", terms(), now=f"2024-01-0{i + 1}")
    store.publish(frame(spark, ("z", 9)), base, "brief", "d9", now="2024-01-01")
    assert payload(store.history(spark, base, "radar"), "age") == [("radar", "d1", "a", 1, 1), ("radar", "d2", "a", 2, 0)]
    assert len(list(Path(base, "data", "provider=radar").iterdir())) == 2
    assert payload(store.history(spark, base, newest=1)) == [("brief", "d9", "z", 9), ("radar", "d2", "a", 2)]
    # an age beyond the limit counts as gone
    assert payload(store.history(spark, base, "radar", ttl_hours=36, now="2024-01-03 12:00:00"), "age") == [("radar", "d1", "a", 1, 1), ("radar", "d2", "a", 2, 0)]
    assert payload(store.history(spark, base, "radar", ttl_hours=12, now="2024-01-03 12:00:00")) == [("radar", "d2", "a", 2)]
    assert store.history(spark, base, ttl_hours=1, now="2025-01-01") is None
    store.publish(frame(spark, ("a", 7)), base, "radar", "d2", terms(), now="2024-01-04")  # again: replaced
    assert payload(store.history(spark, base, "radar")) == [("radar", "d1", "a", 1), ("radar", "d2", "a", 7)]


def bytes_of(base, batch):
    return sum(p.stat().st_size for p in Path(base, "data", f"batch={batch}").rglob("*.parquet"))


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    base = str(tmp_path / "t")
    day = dt.date(2020, 1, 1)
    rows = [(f"S{i % 50}", day + dt.timedelta(days=i // 50), float(i)) for i in range(50 * 365)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    month = F.date_format("trade_date", "yyyy-MM")
    assert store.upsert(bars, base, ["symbol", "trade_date"], 0, month)
    late = bars.where("trade_date = DATE '2020-12-30'").withColumn("close", -F.col("close"))
    assert store.upsert(late, base, ["symbol", "trade_date"], 1, month)
    assert 0 < bytes_of(base, 1) < bytes_of(base, 0) / 6
    whole = store.read_table(spark, base, bars.schema)
    want = sorted((s, t, -c if t == dt.date(2020, 12, 30) else c) for s, t, c in rows)
    assert sorted(map(tuple, whole.collect())) == want
    files = sorted(p.name for p in Path(base).rglob("*"))
    assert not store.upsert(late.withColumn("close", F.lit(0.0)), base, ["symbol", "trade_date"], 1, month)  # a replay
    assert sorted(p.name for p in Path(base).rglob("*")) == files and sorted(map(tuple, store.read_table(spark, base, bars.schema).collect())) == want


def test_upserts_of_odd_rows(spark, tmp_path):
    base = str(tmp_path / "t")
    store.upsert(frame(spark, ("a", 1), ("a", 3), ("a", 2), (None, 1), ("b", None)), base, ["k"], 5)
    store.upsert(frame(spark, ("c", 1)).limit(0), base, ["k"], 6)
    assert [tuple(r) for r in store.read_table(spark, base, "k string, v int").collect()] == [("a", 3)]
    assert store.parts(spark, base)[0] == 6 and store.parts(spark, str(tmp_path / "none")) == (-1, {})


def test_a_stream_of_batches(spark, tmp_path):
    fold = jobs.upsert_into(str(tmp_path / "t"), ["k"])
    source = str(tmp_path / "in")
    for i, row in enumerate((("a", 1), ("b", 1), ("b", 2))):
        frame(spark, row).coalesce(1).write.mode("append").parquet(source)
        q = spark.readStream.schema("k string, v int").parquet(source).writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, store.read_table(spark, str(tmp_path / "t"), "k string, v int").collect())) == [("a", 1), ("b", 2)]
    fold(frame(spark, ("a", 9)), 0)  # seen before
    assert sorted(map(tuple, store.read_table(spark, str(tmp_path / "t"), "k string, v int").collect())) == [("a", 1), ("b", 2)]


def test_ledger(spark, tmp_path):
    base = str(tmp_path / "l")
    trials = lambda *rows: spark.createDataFrame(list(rows), "signal string, variant string")
    assert store.record(trials((None, "x")), base, "r0") == 1 and store.ledger(spark, base).count() == 0
    assert store.record(trials(("mom", "a"), ("mom", "b"), ("mom", "a"), ("rev", None)), base, "r1") == 3
    assert store.record(trials(("mom", "a"), ("mom", "b"), ("rev", None)), base, "r1") == 3
    assert store.record(trials(("rev", ""), ("vol", "a")), base, "r2") == 4
    assert {(r.signal, r.variant): r.run for r in store.ledger(spark, base).collect()} == {("mom", "a"): "r1", ("mom", "b"): "r1", ("rev", ""): "r1", ("vol", "a"): "r2"}
