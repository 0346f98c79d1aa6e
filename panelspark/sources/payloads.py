"""Payload snapshots, freshness, upserts, publication and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshots(events: DataFrame) -> DataFrame:
    """(provider, key, fetched_at, payload, event_id): the events table as payloads."""
    return events.select(F.col("event_type").alias("provider"), F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), F.col("props").alias("payload"), "event_id")


def by_prefix(s: DataFrame, prefix: str) -> DataFrame:
    """Payloads of providers with a prefix; unreadable JSON is left out."""
    return s.where(F.col("provider").startswith(prefix) & F.try_parse_json("payload").isNotNull())


def freshness(s: DataFrame) -> DataFrame:
    return s.groupBy("provider").agg(F.count("*").alias("payloads"), F.max("fetched_at").alias("newest"), F.min("fetched_at").alias("oldest"))


def latest(s: DataFrame) -> DataFrame:
    """The newest payload of each provider and key."""
    return s.groupBy("provider", "key").agg(F.max("fetched_at").alias("fetched_at"), F.max_by("event_id", F.struct("fetched_at", "event_id")).alias("event_id"))


def receipts(wanted: DataFrame, seen: DataFrame, fresh_since: str) -> DataFrame:
    """live, stale or unavailable for each wanted key."""
    state = F.when(F.col("at").isNull(), "unavailable").when(F.col("at") < F.lit(fresh_since).cast("timestamp"), "stale").otherwise("live")
    return wanted.join(seen, "key", "left").select("key", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of each key; rows that lack a value are dropped from the new ones."""
    both = old.withColumn("__g", F.lit(0)).unionByName(new.dropna().withColumn("__g", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__g").alias("__x")).select(*keys, "__x.*")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], first: str) -> DataFrame:
    """``old`` and, of the rows whose key isn't in it, the first of each key."""
    fresh = new.join(old, keys, "left_anti").groupBy(*keys).agg(F.min(first).alias(first))
    return old.unionByName(fresh)


def retained(ids: DataFrame, keep: int) -> DataFrame:
    """The newest snapshots of each provider."""
    k = F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("snapshot_id")))
    return ids.withColumn("k", k).where(F.col("k") <= keep).drop("k")


def publish(df: DataFrame, base: str, snapshot_id: str, keep: int = 2) -> None:
    """Writes a snapshot's directory first and the one-row pointer last, so a reader never
    meets half a snapshot."""
    df.write.mode("overwrite").parquet(f"{base}/snapshot_id={snapshot_id}")
    spark = df.sparkSession
    spark.range(1).select(F.lit(snapshot_id).alias("snapshot_id"), F.current_timestamp().alias("published_at")).coalesce(1).write.mode("overwrite").parquet(f"{base}/_current")


def current(spark, base: str) -> DataFrame:
    """The published snapshot that the pointer names."""
    pointer = spark.read.parquet(f"{base}/_current").first()
    return spark.read.parquet(f"{base}/snapshot_id={pointer['snapshot_id']}")


def contract(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """(term, rows, missing, broken) of each contracted column, in one pass."""
    g = df.agg(F.count("*").alias("rows"), *[x for k, c in broken.items() for x in (F.count_if(F.col(k).isNull()).alias(f"m_{k}"), F.count_if(c).alias(f"b_{k}"))])
    parts = F.array(*[F.struct(F.lit(k).alias("term"), F.col("rows"), F.col(f"m_{k}").alias("missing"), F.col(f"b_{k}").alias("broken")) for k in broken])
    return g.select(F.inline(parts))


def ticker(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(name)), "[.#]", "-")


def canonical(url: Column) -> Column:
    """Lower-case scheme and host; without tracking parameters and fragment."""
    head = r"^[A-Za-z]+://[^/?#]*"
    host = F.regexp_extract(url, head, 0)
    rest = F.substring(F.regexp_replace(url, "#.*$", ""), F.length(host) + 1, F.lit(1 << 30))
    u = F.regexp_replace(F.concat(F.lower(host), rest), r"([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"[?&]+$", ""), r"\?&+", "?"), "&&+", "&")


def panel_receipts(wanted: DataFrame, panels: list[tuple[str, str, float]], seen: DataFrame, now: str) -> DataFrame:
    """(key, panel, source, as_of, age_text, state, note) for each key of ``wanted`` and panel
    (name, source, hours that it stays fresh). ``seen``: (panel, key, as_of, assumed), where
    the panel has data, ``assumed`` naming inputs that fell back to defaults. unavailable: no
    data; no_asof: data of unknown age; stale: older than allowed; else live; assumed takes
    the place of the last three. Ages are whole hours up to two days, then days; a time to
    come is an age of none. Of several rows of a panel and key the newest counts."""
    given = F.array(*[F.struct(F.lit(p).alias("panel"), F.lit(s).alias("source"), F.lit(float(h)).alias("ttl")) for p, s, h in panels])
    newest = seen.groupBy("panel", "key").agg(F.max("as_of").alias("as_of"), F.max_by("assumed", F.struct("as_of", F.size("assumed"))).alias("assumed"), F.lit(True).alias("present"))
    r = wanted.select("key").distinct().select("key", F.inline(given)).join(newest, ["panel", "key"], "left")
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))) / 3.6e9
    age = F.greatest(hours, F.lit(0.0))
    text = F.when(F.col("as_of").isNull(), "").when(age < 1, "<1h old").when(age < 48, F.concat(F.bround(age, 0).cast("int").cast("string"), F.lit("h old"))).otherwise(F.concat(F.bround(age / 24, 0).cast("int").cast("string"), F.lit("d old")))
    some = F.coalesce(F.size("assumed") > 0, F.lit(False))
    state = F.when(F.col("present").isNull(), "unavailable").when(some, "assumed").when(F.col("as_of").isNull(), "no_asof").when(hours > F.col("ttl"), "stale").otherwise("live")
    note = F.when(some, F.concat(F.lit("assumed inputs: "), F.array_join("assumed", ", "))).otherwise("")
    return r.select("key", "panel", "source", "as_of", text.alias("age_text"), state.alias("state"), note.alias("note"))
