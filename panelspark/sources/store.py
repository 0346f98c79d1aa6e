"""Tables that are kept between jobs: publication behind a contract, with retention and
history; upserts that rewrite only the parts a batch touches; an append-only ledger.

All three commit the same way: data first, into folders that nobody reads yet, then a small
manifest. A reader goes by the newest manifest, so it never meets half a write, and a job
that dies before its manifest has changed nothing. One writer a table at a time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.payloads import contract


class ContractBroken(ValueError):
    """A snapshot that isn't published."""


def shared(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="store-")  # one machine, as in tests
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders ``prefix``N in ``path``, ascending."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [n for n in names if n.startswith(prefix) and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix(prefix)) for n in done)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


# -- publication ----------------------------------------------------------------


def manifest(spark: SparkSession, base: str, prefix: str = "") -> DataFrame | None:
    """(provider, snapshot_id, published_at, number) of the retained snapshots of providers
    with a prefix, from each one's newest manifest; None before the first publication."""
    fs, at = _fs(spark, f"{base}/manifest")
    if not fs.exists(at):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    found = [(n, _numbers(spark, f"{base}/manifest/{n}", "m-")) for n in names if n.removeprefix("provider=").startswith(prefix)]
    paths = [f"{base}/manifest/{n}/m-{k[-1]}" for n, k in found if k]
    return spark.read.option("basePath", f"{base}/manifest").schema("snapshot_id string, published_at timestamp, number bigint, provider string").parquet(*paths) if paths else None


def publish(df: DataFrame, base: str, provider: str, snapshot_id: str, terms: dict[str, Column] | None = None, keep: int = 2, now: str | None = None) -> None:
    """Publishes ``df`` as a provider's snapshot. ``terms``: per column what breaks it; a
    null there breaks it too, and so does an empty snapshot; then ContractBroken is raised,
    and the provider's pointer stays where it was. The ``keep`` newest snapshots stay; those
    before are deleted after the pointer has moved. A snapshot_id that comes again replaces
    its snapshot and is the newest."""
    spark = df.sparkSession
    path = f"{base}/data/provider={provider}/snapshot_id={snapshot_id}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    if terms:
        found = contract(written, terms).collect()  # a row a term
        bad = [r for r in found if r["missing"] or r["broken"] or not r["rows"]]
        if bad:
            _delete(spark, path)
            raise ContractBroken("; ".join(f"{r['term']}: {r['rows']} rows, {r['missing']} missing, {r['broken']} broken" for r in bad))
    home = f"{base}/manifest/provider={provider}"
    numbers = _numbers(spark, home, "m-")
    number = numbers[-1] + 1 if numbers else 0
    held = [tuple(r) for r in spark.read.parquet(f"{home}/m-{numbers[-1]}").collect()] if numbers else []  # ``keep`` rows
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    stamp = spark.range(1).select(at.alias("t")).first()["t"]
    folder = path.rsplit("=", 1)[1]
    rows = sorted([*(r for r in held if r[0].rsplit("-", 1)[0] != snapshot_id), (folder, stamp, number)], key=lambda r: r[2])
    spark.createDataFrame(rows[-keep:], "snapshot_id string, published_at timestamp, number bigint").coalesce(1).write.parquet(f"{home}/m-{number}")
    for gone in {r[0] for r in [*held, *rows]} - {r[0] for r in rows[-keep:]}:
        _delete(spark, f"{base}/data/provider={provider}/snapshot_id={gone}")
    for old in numbers:
        _delete(spark, f"{home}/m-{old}")


def history(spark: SparkSession, base: str, prefix: str = "", newest: int | None = None, ttl_hours: float | None = None, now: str | None = None) -> DataFrame | None:
    """Rows of the retained snapshots of providers with a prefix, with provider, snapshot_id,
    published_at and age (0: the published one); ``newest=1`` reads what is published. Those
    older than ``ttl_hours`` count as gone. None if there is nothing."""
    m = manifest(spark, base, prefix)
    if m is None:
        return None
    if ttl_hours is not None:
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        m = m.where(F.unix_micros(at) - F.unix_micros("published_at") <= int(ttl_hours * 3_600_000_000))
    m = m.withColumn("age", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("number"))) - 1)
    rows = m.where(F.col("age") < newest).collect() if newest else m.collect()  # ``keep`` a provider
    paths = [f"{base}/data/provider={r.provider}/snapshot_id={r.snapshot_id}" for r in rows]
    if not paths:
        return None
    payload = spark.read.option("basePath", f"{base}/data").option("mergeSchema", "true").parquet(*paths)
    out = payload.join(m.drop("number"), ["provider", "snapshot_id"])
    return out.withColumn("snapshot_id", F.regexp_replace("snapshot_id", "-[0-9a-f]{32}$", ""))


# -- upserts ----------------------------------------------------------------------


def parts(spark: SparkSession, base: str) -> tuple[int, dict[str, int]]:
    """The newest batch folded into the table at ``base`` (-1: none), and the batch that wrote
    each part last."""
    numbers = _numbers(spark, f"{base}/manifest", "m-")
    if not numbers:
        return -1, {}
    return numbers[-1], {r.part: r.batch for r in spark.read.parquet(f"{base}/manifest/m-{numbers[-1]}").collect()}  # a row a part


def _read(spark: SparkSession, base: str, at: dict[str, int], schema) -> DataFrame:
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/data/batch={b}/part={p}" for p, b in sorted(at.items())])


def read_table(spark: SparkSession, base: str, schema) -> DataFrame:
    """What the table holds."""
    return _read(spark, base, parts(spark, base)[1], schema)


def by_hash(keys: list[str], n: int = 64) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("string")


def upsert(batch: DataFrame, base: str, keys: list[str], batch_id: int, part: Column | None = None, order: str | None = None) -> bool:
    """Folds a batch into the table at ``base``: the last write of each key stays, rows with
    a null are left out, and of a batch's rows of one key that with the greatest ``order``
    (else the greatest by its columns) counts. ``part`` deals rows into parts (by a hash of
    the keys unless told otherwise; a month of bars, say) and must follow from the keys. Only
    parts that the batch touches are read and written. A batch_id not above the last one is
    a replay and changes nothing (False)."""
    spark, schema = batch.sparkSession, batch.schema
    last, at = parts(spark, base)
    if batch_id <= last:
        return False
    rest = [c for c in batch.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest))
    new = batch.dropna().groupBy(*keys).agg(best.alias("__x")).select(*keys, "__x.*").select(batch.columns)
    where = part if part is not None else by_hash(keys)
    touched = sorted(r[0] for r in new.select(where).distinct().collect())  # a row a part
    if touched:
        old = _read(spark, base, {p: b for p, b in at.items() if p in set(touched)}, schema)
        both = old.join(new.select(keys), keys, "left_anti").unionByName(new)
        both.withColumn("part", where).repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{base}/data/batch={batch_id}")
    rows = [*({**at, **{p: batch_id for p in touched}}).items()]
    spark.createDataFrame(rows, "part string, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/m-{batch_id}")
    for p in touched:
        if p in at:
            _delete(spark, f"{base}/data/batch={at[p]}/part={p}")
    if last >= 0:
        _delete(spark, f"{base}/manifest/m-{last}")
    return True


# -- ledger -----------------------------------------------------------------------


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """(signal, variant, run) of all trials recorded."""
    return read_table(spark, base, "signal string, variant string, run string")


def record(trials: DataFrame, base: str, run: str) -> int:
    """Appends the trials (signal, variant) that the ledger hasn't got, under ``run``, and
    returns how many it holds then, one at least. A run that comes again adds nothing."""
    spark = trials.sparkSession
    new = trials.select("signal", F.coalesce("variant", F.lit("")).alias("variant")).where("signal IS NOT NULL").distinct()
    new = new.join(ledger(spark, base), ["signal", "variant"], "left_anti").withColumn("run", F.lit(run))
    if not new.isEmpty():
        upsert(new, base, ["signal", "variant"], parts(spark, base)[0] + 1, by_hash(["signal", "variant"], 8))
    return max(1, ledger(spark, base).count())
