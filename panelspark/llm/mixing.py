"""Mixing sources to target weights.

Targets are set by weight, capped and reshared; each source's rows are put in a
hashed permutation, and the blocks (a row, or a row's second pass) at its front are
drawn. A splitting tree cuts each source's block quota into exact quotas of the
output shards by multivariate hypergeometric draws; a shard takes its disjoint range
of the permuted blocks and shuffles it locally."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

WEIGHTS, FACTOR, CAP, SEED, N_SHARDS = (5, 2, 1), 1.5, 2, "mix-1", 16
#: Of the generator's hypergeometric draw: a fixed value.
MOST_DRAWN = 10**9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, n, source_size, target, passes, rest) from (source, size): one row per
    source. Sources by code point, null last, weigh 5, 2, 1, repeating. A source whose
    share by weight passes CAP times its size stops there; sorted by size over weight,
    those that stop come first, so the level is a running sum away. ``passes`` whole
    passes and ``rest`` words of one more make the target, rounded down."""
    by = sizes.groupBy("source").agg(F.count(F.when(F.col("size") > 0, 1)).alias("n"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    by = by.withColumn("w", reduce(lambda c, i: c.when(turn == i, WEIGHTS[i]), range(1, len(WEIGHTS)), F.when(turn == 0, WEIGHTS[0])))
    by = by.withColumn("ratio", CAP * F.col("source_size") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("left", FACTOR * F.sum("source_size").over(all_) - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    by = by.withColumn("level", F.col("left") / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    by = by.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_))
    target = F.least((CAP * F.col("source_size")).cast("double"), F.coalesce(F.col("w") * F.col("level"), F.lit(float("inf"))))
    by = by.withColumn("target", target)
    whole = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    by = by.withColumn("passes", passes.cast("bigint"))
    return by.select("source", "n", "source_size", "target", "passes", (whole - F.col("passes") * F.col("source_size")).cast("bigint").alias("rest"))


def hash_of(doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(SEED)).cast("binary"))


def permuted(rows: DataFrame) -> DataFrame:
    """Adds rank (among the source's rows with words) and ahead (words before the row),
    both in the order of a seeded hash. Sums run inside hashed buckets of a source;
    the buckets' own sums (at most 65,536 rows a source) give where each starts. So
    a hot source is spread over all tasks."""
    rows = rows.withColumn("hash", hash_of(F.col("doc_id"))).withColumn("bucket", F.substring("hash", 1, 4))
    some = F.when(F.col("size") > 0, 1).otherwise(0)
    starts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.sum(some).alias("some"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("some").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"w1": F.sum("size").over(inside) - F.col("size"), "r1": F.sum(some).over(inside) - some})
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.withColumns({"ahead": F.col("w0") + F.col("w1"), "rank": F.col("r0") + F.col("r1")}).drop("s", "b", "w0", "w1", "r0", "r1", "bucket")


def drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw: the good ones among ``n`` of good + bad. Populations beyond
    the generator's bound are thinned: each element is taken by itself with probability
    n / (good + bad), which takes n up to a square root of it, and the rest are taken
    from, or given back to, the others by such a draw again."""
    if good < MOST_DRAWN and bad < MOST_DRAWN:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    if n <= 32:
        got = 0
        for k in range(n):
            got += int(rng.integers(good + bad - k) < good - got)
        return got
    if 2 * n > good + bad:
        return good - drawn(rng, good, bad, good + bad - n)
    share = n / (good + bad)
    g, b = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    return g - drawn(rng, g, b, g + b - n) if g + b > n else g + drawn(rng, good - g, bad - b, n - g - b)


def split_quotas(quotas: DataFrame, n_shards: int, seed: str = SEED) -> DataFrame:
    """(source, cuts): where each shard's range of the source's permuted blocks ends.
    From (source, quota). Each node of the tree holds the quotas of a run of shards and
    draws, without replacement, what its first half of shards gets of each source."""

    def halve(key, part: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(key[0]), int(key[1])
        part = part.sort_values("source", na_position="last")
        quota = part["quota"].to_numpy(np.int64)
        if hi - lo == 1:
            return part
        mid = (lo + hi) // 2
        share = int(quota.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{lo}:{hi}".encode()).digest()[:8], "big"))
        first, left, want = np.zeros_like(quota), int(quota.sum()), share
        for i, q in enumerate(quota.tolist()):  # one hypergeometric draw a source
            left -= q
            got = drawn(rng, q, left, want)
            first[i], want = got, want - got
        return pd.concat([part.assign(lo=lo, hi=mid, quota=first), part.assign(lo=mid, hi=hi, quota=quota - first)])

    nodes = quotas.select("source", F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), F.col("quota").cast("bigint"))
    for _ in range((n_shards - 1).bit_length()):
        nodes = nodes.groupBy("lo", "hi").applyInPandas(halve, nodes.schema)
    ends = nodes.withColumn("end", F.sum("quota").over(Window.partitionBy("source").orderBy("lo")))
    return ends.groupBy("source").agg(F.array_sort(F.collect_list("end")).alias("cuts"))


def place_of(shard: Column, doc_id: Column, turn: Column) -> Column:
    """The order of a block in its shard: the shard's own shuffle."""
    return F.md5(F.concat_ws(":", shard, F.coalesce(doc_id.cast("string"), F.lit("")), turn, F.lit(SEED)).cast("binary"))


def planned(docs: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame, Column, Column]:
    """(rows, cuts, blocks drawn of a row, words of its cut block) as ``mix`` needs them."""
    sizes = table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    goals = table(targets(sizes))
    same = F.col("source").eqNullSafe(F.col("s"))
    rows = table(permuted(sizes).join(goals.withColumnRenamed("source", "s"), same).drop("s"))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    drawn_ = F.when(F.col("size") > 0, F.col("passes") + F.when(extra > 0, 1).otherwise(0)).otherwise(0)
    quotas = rows.groupBy("source").agg(F.sum(drawn_).cast("bigint").alias("quota"))
    return rows, table(split_quotas(quotas, n_shards)).withColumnRenamed("source", "s"), drawn_, extra


def mix(docs: DataFrame, n_shards: int = N_SHARDS) -> tuple[DataFrame, DataFrame]:
    """Two tables. Rows: doc_id, source, size, source_size, target, ahead, rank; one
    per row of ``docs``. Blocks: doc_id, source, size, rank, pass, words, shard, place; one
    for each block that a shard draws, ``place`` being its shuffled order in its shard. The
    last block of a source may be cut, so each source's words are its target, rounded down.
    Null text: size 0, never drawn; null source: a source of its own, last in order; rows
    with equal doc_id are rows of their own; other columns are left out; an empty table
    gives empty tables."""
    rows, cuts, drawn_, extra = planned(docs, n_shards)
    blocks = rows.where(F.col("size") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), drawn_.cast("int") - 1))))
    blocks = blocks.withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(extra))
    blocks = blocks.withColumn("block", F.col("pass") * F.col("n") + F.col("rank"))
    blocks = blocks.join(cuts, F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("block")))).where(F.col("shard") < n_shards)
    return rows, blocks.select("doc_id", "source", "size", "rank", "pass", "words", "shard", place_of(F.col("shard"), F.col("doc_id"), F.col("pass")).alias("place"))


def shard_starts(docs: DataFrame, n_shards: int = N_SHARDS, least: float = 0.5) -> DataFrame:
    """(s, starts): a row a source. The blocks of a source in drawn order are compared by
    (pass, hash, doc_id); ``starts`` holds the first block of each shard's range and the
    end of the last, so whoever holds a row can tell its blocks' shards without a join on
    rows. A last block that is cut to less than ``least`` of its size is left out. Needs
    distinct, non-null doc_ids."""
    rows, cuts, drawn_, extra = planned(docs, n_shards)
    some = rows.where(F.col("size") > 0)
    short = some.where((extra > 0) & (extra < least * F.col("size"))).select(F.col("source").alias("t"), F.lit(1).alias("less"))
    cuts = cuts.join(short, F.col("s").eqNullSafe(F.col("t")), "left")
    ends = cuts.select("s", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), "cuts")).alias("k", "c"), (F.element_at("cuts", -1) - F.coalesce("less", F.lit(0))).alias("most"))
    ends = ends.withColumn("c", F.least("c", "most")).drop("most")
    # the block at place c is in pass c / n, at rank c % n
    sources = some.select(F.col("source").alias("t"), "n").distinct()
    ends = table(ends.join(sources, F.col("s").eqNullSafe(F.col("t"))).select("s", "k", F.floor(F.col("c") / F.col("n")).alias("pass"), (F.col("c") % F.col("n")).alias("rank")))
    found = ends.join(some.select("source", F.col("rank").alias("r"), "hash", "doc_id"), F.col("s").eqNullSafe(F.col("source")) & (F.col("rank") == F.col("r")))
    starts = F.array_sort(F.collect_list(F.struct("k", F.struct(F.col("pass").cast("int").alias("pass"), "hash", F.col("doc_id").alias("id")).alias("at"))))
    return table(found.groupBy("s").agg(F.transform(starts, lambda x: x["at"]).alias("starts")))


def draw(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The rows of the mix, with their text: a row of ``docs`` for each of its blocks that a
    shard draws, and its shard and place. Texts stay where they are: what each shard draws of
    each source comes as ranges of the permutation (``shard_starts``), a row a source. Needs
    distinct, non-null doc_ids; other inputs as in ``mix``."""
    starts = shard_starts(docs, n_shards)
    docs = docs.withColumn("__hash", hash_of(F.col("doc_id")))
    both = docs.where(n_words(F.col("text")) > 0).join(starts, F.col("source").eqNullSafe(F.col("s")))
    both = both.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(CAP))))
    own = F.struct(F.col("__pass").cast("int").alias("pass"), F.col("__hash").alias("hash"), F.col("doc_id").alias("id"))
    both = both.withColumn("__at", own).withColumn("shard", F.size(F.filter("starts", lambda x: x <= F.col("__at"))) - 1).where(F.col("shard") < n_shards)
    return both.withColumn("place", place_of(F.col("shard"), F.col("doc_id"), F.col("__pass"))).drop("__hash", "__pass", "__at", "s", "starts")


def taken(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken."""
    rows, blocks = mix(docs, n_shards)
    got = blocks.groupBy(F.col("source").alias("s"), F.col("rank").alias("k")).agg(F.sum("words").alias("taken"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("k")) & (F.col("size") > 0)
    return rows.join(got, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
r AS (SELECT *, {CAP} * source_size / w AS ratio FROM s),
l AS (SELECT *, ({FACTOR} * sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER o, 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(({CAP} * source_size)::DOUBLE, coalesce(w * max(level) FILTER (level <= ratio) OVER (), 'inf'::DOUBLE)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS passes FROM t),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target) - passes * source_size - ahead)))::BIGINT AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source"""
