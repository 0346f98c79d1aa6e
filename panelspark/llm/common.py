"""Shared helpers: words, Arrow text buffers, scratch tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"
#: Of a 64-bit mixing function (splitmix64): fixed values.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

BATCH = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The text's words, A-Z in lower case; an empty array for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BLANKS), "")


def crc_sql(text: str) -> str:
    """DuckDB's expression for the CRC-32 of a string's UTF-8 bytes."""
    steps = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps.append(c)
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({code}, lambda c, b: xor(({steps})[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8), 4294967295), 4294967295)"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most 4 MB a batch: 10,000 rows, Spark's bound, of long texts
    don't fit beside each other. A smaller bound of the session's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(key) or "").removesuffix("b")
    if not held.isdigit() or int(held) > BATCH:
        spark.conf.set(key, str(BATCH))


def table(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: lineage is cut, a lost executor costs
    nothing, and the planner knows the size (so it broadcasts only what is small)."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps: the scheduler holds
    on to its last job, so a small one takes its place first."""
    spark.range(1).repartition(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(docs: DataFrame, each: int, column: str = "text") -> int:
    """Into how many buckets to deal what is gathered a bucket: by the bytes of ``docs``, so
    that a bucket holds ``each`` at most on average, and one a shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(docs.sparkSession), total // each + 1)


# -- inside tasks -------------------------------------------------------------


def frees(run):
    """Wraps what a task runs: at its end the worker, which waits for other tasks beside the
    JVM, gives the memory that allocators hold back to the system."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            freed()

    return wrapped


def freed() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values."""
    x = x + np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, and the odd base of rolling sums.
BYTE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
BASE = 0x5851F42D4C957F2D
#: The same for a second hash.
BYTE2, BASE2 = mix(BYTE), 0x2545F4914F6CDD1D


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Hashes of any spans of a byte string, from prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE, base: int = BASE):
        up, self.down = powers(len(data) + 1, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, one after another, and where each row starts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def offsets(column: pa.Array) -> np.ndarray:
    """Where each row's bytes start, if rows are put one after another."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(size, dtype=np.int64))


def pieces(at: np.ndarray, most: int = 1 << 18):
    """Row ranges of at most ``most`` bytes, but at least one row, each."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


# -- connected components -----------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``: the smallest node that it
    reaches. Each round links every node and its neighbours to the smallest node
    around, then to that one's smallest; no group is gathered, and each round is
    written to the shared folder."""
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    both = table(both)
    while True:
        # large star: neighbours above a node go to the smallest around it
        ways = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: neighbours below a node go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # done when every node has one smaller neighbour and that one has none
        parents = step.select(F.col("u").alias("v")).distinct()
        n, d = step.agg(F.count("*"), F.countDistinct("u")).first()
        if n == d and step.join(parents, "v", "left_semi").isEmpty():
            break
        both = step
    roots = step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
