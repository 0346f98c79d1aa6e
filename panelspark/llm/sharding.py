"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_SHARDS, TABLE_SIZE = 32, 4099


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of a shard. ``size`` is a prime of 100 or more times the number
    of shards. Each shard walks its own permutation of the slots; in turns, each
    claims the next free slot of its walk. Shares differ by one slot at most, and a
    shard's going moves few slots of the others. An empty list of shards: ValueError."""
    if not names or size < len(names):
        raise ValueError("needs a shard at least, and a slot for each")
    walks = []
    for name in names:
        h = hashlib.md5(name.encode()).digest()
        walks.append([int.from_bytes(h[:8], "big") % size, int.from_bytes(h[8:], "big") % (size - 1) + 1 if size > 1 else 0])
    owner, free, turn = [-1] * size, size, 0
    while free:
        walk = walks[turn]
        while owner[walk[0]] >= 0:
            walk[0] = (walk[0] + walk[1]) % size
        owner[walk[0]] = turn
        free -= 1
        turn = (turn + 1) % len(names)
    return owner


def names_of(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """52 bits of the key's MD5, modulo the table's size; null counts as ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") % size).cast("int")


def place(df: DataFrame, key: str = "doc_id", names: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with columns slot and shard (ints). The table has ``size`` rows whatever
    the input, so it is broadcast; rows stay where they are. Equal keys meet in one
    shard, null keys in the shard of ''; columns of ``df`` named slot or shard are
    replaced; an empty table gives an empty table."""
    owner = lookup_table(names or names_of(N_SHARDS), size)
    one = df.sparkSession.range(1)
    slots = one.select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias("slot", "shard"))
    slots = slots.select("slot", F.col("shard").cast("int").alias("shard"))
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(slots), "slot").select(*[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def shard_sql() -> str:
    owner = ",".join(map(str, lookup_table(names_of(N_SHARDS))))
    return f"""
    WITH t AS (SELECT [{owner}] AS owner),
    s AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
    SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM s, t"""
