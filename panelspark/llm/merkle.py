"""A Merkle manifest of a dataset: leaves, subroots of sources, root, proofs.

Rows of a source are numbered exactly by a range partitioning: a row's number is its place
in its partition plus the rows of its source in the partitions before. Runs of 16 nodes
are then windows: per level, lag and lead columns of the fixed offsets 1 to 15, masked by
a node's slot and its run's length, are its siblings, and the rows of first children hash
the parents. A level has a sixteenth of the rows of the one below and is written to the
shared folder. Proofs go down again: a node's path is its own siblings and its parent's
path, so no path is longer than the tree is high. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, crc_sql, partitions, table

FAN = 16
#: Rows of one range partition, on average, at most.
ROWS = 1 << 20
#: A row is tampered with where this divides the CRC of its doc_id.
TAMPER = 5
SIBLINGS = "array<struct<left:string,right:string>>"


def field(column: Column) -> Column:
    """A value with its length in bytes before it; '-' for null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, start): ``key`` orders sources, null first; ``start`` is the leaf
    that a proof is folded from, of the tampered row if it is one."""
    low = F.translate("text", UPPER, LOWER)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    fields = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = F.sha2(F.concat(*fields, field(F.col("text"))), 256)
    other = F.sha2(F.concat(*fields, field(low)), 256)
    key = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    rows = docs.select(key.alias("key"), "doc_id", leaf.alias("leaf"), F.when(tampered, other).alias("start"))
    return rows.withColumn("start", F.coalesce("start", "leaf"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, the number of a row among those of its ``key`` in the order of
    ``order`` (null first), and n, how many they are."""
    spark = rows.sparkSession
    parts = max(partitions(spark), rows.count() // ROWS + 1)
    ordered = [F.col(c).asc_nulls_first() for c in ("key", *order)]
    rows = rows.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered)
    rows = table(rows.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    # a row a key and partition: as many as partitions and keys together at most
    first = rows.groupBy("key", "part").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy("key").orderBy("part")
    first = first.withColumns({"n": F.sum("held").over(Window.partitionBy("key")), "base": F.sum("held").over(before) - F.col("held")})
    first = table(first.select("key", "part", "n", (F.col("base") - F.col("first")).alias("shift")))
    return rows.join(first, ["key", "part"]).withColumn("idx", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds run and slot, and left and right: the digests of the run's other nodes."""
    nodes = nodes.withColumns({"run": F.floor(F.col("idx") / FAN).cast("bigint"), "slot": (F.col("idx") % FAN).cast("int")})
    w = Window.partitionBy("key", "run").orderBy("idx")
    length = F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(w)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(w)) for k in range(1, FAN)]
    return nodes.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def above(nodes: DataFrame) -> DataFrame:
    """The parents of the nodes of trees that have more than one."""
    first = with_siblings(nodes.where("n > 1")).where("slot = 0")
    return first.select("key", F.col("run").alias("idx"), F.ceil(F.col("n") / FAN).cast("bigint").alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (key, idx, n, digest) and the levels above, up to a single node a key."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    found = [nodes.select("key", "idx", "n", "digest")]
    while most > 1:
        found.append(table(above(found[-1])))
        most = -(-most // FAN)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """(key, digest) of the single nodes at the end."""
    out = found[0].where("n = 1")
    for level in found[1:]:
        out = out.unionByName(level.where("n = 1"))
    return out.select("key", "digest")


def with_path(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """Adds path, the siblings of each level from the node upwards. ``up``: (key, idx, path)
    of the parents, or of the whole tree where the node has no siblings' level."""
    up = up.select("key", F.col("idx").alias("run"), F.col("path").alias("rest"))
    nodes = with_siblings(nodes).join(up, ["key", "run"])
    own = F.array(F.struct("left", "right")).cast(SIBLINGS)
    return nodes.withColumn("path", F.when(F.col("n") > 1, F.concat(own, "rest")).otherwise(F.col("rest"))).drop("run", "slot", "left", "right", "rest")


def paths(found: list[DataFrame], end: DataFrame) -> DataFrame:
    """(key, idx, path) of what the lowest level of ``found`` looks up. ``end``: (key, path)
    above the single nodes."""
    up = None
    for i in reversed(range(len(found))):
        closed = found[i].where("n = 1").select("key", "idx").join(end, "key")
        here = closed if up is None else up.unionByName(closed)
        if i == 0:
            break
        up = closed if up is None else table(with_path(found[i].where("n > 1"), here).select("key", "idx", "path").unionByName(closed))
    return here


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row a row of
    ``docs``. A null doc_id comes first in its source and isn't tampered with; a null source
    is one of its own, before all others; rows with equal doc_ids are ordered by their
    leaves, so equal rows may swap places but not results; an empty text is a value, a null
    one is '-'; other columns are left out; an empty table gives an empty table; a lone
    document is its own root, its proof the hash of nothing."""
    rows = numbered(leaves(docs), ["doc_id", "leaf"])
    rows = table(rows.select("key", "idx", "n", "doc_id", "leaf", "start"))
    inner = levels(rows.withColumn("digest", F.col("leaf")))
    subroots = table(tops(inner))
    outer_rows = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), ["source"])
    outer_rows = table(outer_rows.select("key", "idx", "n", "source", "digest"))
    outer = levels(outer_rows)
    root = tops(outer).select("key", F.col("digest").alias("root"))
    none = F.array().cast(SIBLINGS)
    outer_up = paths(outer, root.select("key", none.alias("path")))
    ends = table(with_path(outer_rows, outer_up).join(root, "key").select(F.col("source").alias("key"), F.col("digest").alias("subroot"), "root", "path"))
    up = paths(inner, ends.select("key", "path"))
    out = with_path(rows.withColumn("digest", F.col("leaf")), up).join(ends.select("key", "subroot", "root"), "key")
    proof = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = F.aggregate("path", F.col("start"), lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: The trees of sources and that of subroots; both climb in one recursive table each.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || source, '0') AS k, {_LEAF.format("text")} AS leaf,
  CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % {TAMPER} = 0 THEN {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
up AS (SELECT k, 0 AS lv, i, n, leaf AS h FROM p UNION ALL
  SELECT k, lv + 1, i // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, lv, i // {FAN}),
s AS (SELECT k, h, lv, row_number() OVER (ORDER BY encode(k)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, i, n, h FROM s UNION ALL
  SELECT lv + 1, i // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // {FAN}),
around AS (SELECT k, lv, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY k, lv, i // {FAN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY k, lv, i // {FAN} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM up),
round AS (SELECT lv, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY lv, i // {FAN} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY lv, i // {FAN} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM top),
walk AS (SELECT doc_id, leaf, k, i AS own, i, 0 AS lv, false AS outer_, coalesce(other, leaf) AS h, '' AS proof, false AS done FROM p UNION ALL
  SELECT w.doc_id, w.leaf, w.k, own, CASE WHEN outer_ THEN w.i // {FAN} WHEN a.n > 1 THEN w.i // {FAN} ELSE s.i END, CASE WHEN outer_ THEN w.lv + 1 WHEN a.n > 1 THEN w.lv + 1 ELSE 0 END, outer_ OR a.n = 1,
    CASE WHEN outer_ THEN CASE WHEN t.n > 1 THEN sha256(t.l || w.h || t.r) ELSE w.h END WHEN a.n > 1 THEN sha256(a.l || w.h || a.r) ELSE w.h END,
    CASE WHEN outer_ THEN w.proof || CASE WHEN t.n > 1 THEN t.l || t.r ELSE '' END WHEN a.n > 1 THEN w.proof || a.l || a.r ELSE w.proof END, outer_ AND t.n = 1
  FROM walk w LEFT JOIN around a ON NOT outer_ AND a.k = w.k AND a.lv = w.lv AND a.i = w.i LEFT JOIN s ON s.k = w.k LEFT JOIN round t ON outer_ AND t.lv = w.lv AND t.i = w.i WHERE NOT w.done)
SELECT doc_id, leaf, s.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, walk.h AS folded_root, walk.h = top.h AS verified
FROM walk JOIN s USING (k) JOIN top ON top.n = 1 WHERE done"""
