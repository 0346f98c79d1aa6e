"""Document fingerprints: one-permutation MinHash with optimal densification.

A text's shingles are hashed once; the first bits of a hash are its bin, and a bin keeps
its least hash. An empty bin takes over the value of the full bin that comes first in a
permutation of the bins of its own, so equal sets stay equal and each full bin is as
likely to be taken. The low 8 bits of the 128 values are stored; bins that agree by
chance, 1 in 256, are taken out of the estimate. DataFrame expressions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions
from .shingles import with_minima, with_shingles

BIN_BITS, LOW_BITS = 7, 8


def with_slots(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint as 128 bytes (array<tinyint>), empty for a text without words."""
    n, shift, low = 1 << BIN_BITS, 64 - BIN_BITS, (1 << LOW_BITS) - 1
    df = with_minima(with_shingles(df, text, "__s"), "__s", "__m", BIN_BITS).drop("__s")
    # a full bin: its number above its low bits
    df = df.withColumn("__p", F.transform("__m", lambda x: F.shiftleft(F.shiftright(x, shift) + n // 2, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit(low))))).drop("__m")

    def first_full(j: Column) -> Column:
        """The low bits of the full bin that comes first in bin j's permutation."""
        order = F.transform("__p", lambda p: F.xxhash64(j, F.shiftright(p, LOW_BITS)).bitwiseAND(F.lit(~low)).bitwiseOR(p.bitwiseAND(F.lit(low))))
        return F.shiftleft(j, LOW_BITS).bitwiseOR(F.array_min(order).bitwiseAND(F.lit(low)))

    bins = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    empty = F.array_except(bins, F.transform("__p", lambda p: F.shiftright(p, LOW_BITS)))
    slots = F.sort_array(F.concat("__p", F.transform(empty, first_full)))
    slots = F.transform(slots, lambda v: (v.bitwiseAND(F.lit(low)) - F.lit(1 << LOW_BITS - 1)).cast("tinyint"))
    return df.withColumn(out, F.when(F.size("__p") > 0, slots).otherwise(F.array().cast("array<tinyint>"))).drop("__p")


def packed(slots: Column) -> Column:
    """The fingerprint as lowercase hex."""
    return F.array_join(F.transform(slots, lambda v: F.substring(F.lower(F.hex(v.cast("bigint") + 3 * (1 << LOW_BITS - 1))), -2, 2)), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity; of texts without words 1 to each other and 0 to
    others."""
    chance = 1 / (1 << LOW_BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(1 << BIN_BITS))
    found = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(found)


def range_of(edges: list[int], tie: Column) -> Column:
    """How many of the sorted ``edges`` lie below (key, tie). An edge that comes c times is
    a key with c ranges' share of the rows or more: its rows are dealt out by ``tie``, a
    hash. Edges are looked up in blocks, so a row is held against about twice their root."""
    if not edges:
        return F.lit(0)
    n = math.isqrt(len(edges)) + 1
    blocks = [edges[i : i + n] for i in range(0, len(edges), n)]
    all_, last = F.lit(blocks).cast("array<array<bigint>>"), F.lit([b[-1] for b in blocks]).cast("array<bigint>")
    full = F.size(F.filter(last, lambda e: e < F.col("key")))
    below = full * n + F.size(F.filter(F.coalesce(F.get(all_, full), F.array().cast("array<bigint>")), lambda e: e < F.col("key")))
    hot = {e: c for e, c in Counter(edges).items() if c > 1}
    if hot:
        share = F.coalesce(F.element_at(F.map_from_arrays(F.lit([*hot]).cast("array<bigint>"), F.lit([*hot.values()])), F.col("key")), F.lit(0))
        below = below + F.floor((F.shiftrightunsigned(tie, 32) / F.lit(2.0**32)) * (share + 1))
    return below.cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_slots of the row that follows by descending doc_id, the
    first following the last. Rows are dealt out once by ranges of doc_id; each range
    also gets the greatest row of the range below (the lowest range: of the highest)."""
    n = 2 * partitions(docs.sparkSession)
    edges = docs.select(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    docs = docs.withColumn("tie", F.xxhash64("text"))
    order = F.struct("key", F.shiftrightunsigned("tie", 1).alias("high"), "tie")
    docs = docs.withColumns({"range": range_of(sorted(edges), F.col("tie")), "order": order})
    tops = sorted((r[0], *r[1]) for r in docs.groupBy("range").agg(F.max("order")).collect())  # a row a range
    goes = {(key, tie): to[0] for (_, key, _, tie), to in zip(tops, [*tops[1:], *tops[:1]])}
    names = [f"{key}:{tie}" for key, tie in goes]
    target = F.element_at(F.map_from_arrays(F.lit(names).cast("array<string>"), F.lit([*goes.values()]).cast("array<int>")), F.concat_ws(":", "key", "tie"))
    ghosts = docs.where(F.col("key").isin([key for key, _ in goes])).withColumn("range", target).where("range IS NOT NULL")
    # rows that are equal to the top row go along once
    ghosts = ghosts.dropDuplicates(["range"])
    both = docs.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    both = with_slots(both, "text", "slots")
    w = Window.partitionBy("range").orderBy("ghost", F.desc("order"))
    both = both.withColumns({"next_text": F.lead("text").over(w), "next_slots": F.lead("slots").over(w)})
    return both.where("NOT ghost").drop("range", "ghost", "order")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The edited text has the last third of
    its code points replaced by the first of the next document. Null text counts as
    empty; null doc_id comes last by descending doc_id; rows with equal doc_id follow
    each other by a hash of their text; a single row follows itself; other columns are
    left out; an empty table gives an empty table."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    rows = with_next(rows)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring("next_text", F.lit(1), cut)))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "edited", "slots", "next_slots")
    rows = with_slots(rows, "edited", "edited_slots")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("slots")).alias("fingerprint"), packed(F.col("edited_slots")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"), likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )
