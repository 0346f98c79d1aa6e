"""Articles of listings: six predicates, and a two-pass identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.payloads import canonical


def acceptable(items: DataFrame, now: str, days: int = 7, language: str = "en") -> DataFrame:
    """Items (position, id, url, title, language, published_at, entities) in the language,
    with a title that isn't blank, an id, a web address, and published in the last ``days``
    days, not after ``now``; with the address in canonical form. Nulls fail."""
    at = F.lit(now).cast("timestamp")
    ok = (
        (F.col("language") == language) & (F.trim("title") != "") & F.col("id").isNotNull() & F.lower("url").rlike(r"^https?://[^/?#\s]+")
        & (F.col("published_at") <= at) & (F.col("published_at") >= at - F.expr(f"INTERVAL {days} DAYS"))
    )
    return items.where(ok).withColumns({"title": F.trim("title"), "url": canonical(F.col("url"))})


def of_listings(items: DataFrame, listings: DataFrame, now: str, days: int = 7, most: int = 500) -> DataFrame:
    """(symbol, id, url, title, published_at) of each listing (symbol, country, exchange),
    newest first, ``most`` at most a listing (a report's length). An article is a listing's
    if some entity of its array has the symbol, in any case, and the listing's country (in
    any case) and exchange, where the listing has one. Of a listing's articles with one
    address the first by position stays, and of those left with one id the first."""
    a = acceptable(items, now, days)
    names = F.array_distinct(F.transform("entities", lambda e: F.upper(e["symbol"])))
    met = a.withColumn("__s", F.explode(names)).join(listings.where("symbol IS NOT NULL").withColumnsRenamed({"country": "__c", "exchange": "__x"}), F.col("__s") == F.col("symbol"))
    fits = lambda e: (F.upper(e["symbol"]) == F.col("symbol")) & (F.col("__c").isNull() | F.coalesce(F.lower(e["country"]) == F.lower("__c"), F.lit(False))) & (F.col("__x").isNull() | F.coalesce(e["exchange"] == F.col("__x"), F.lit(False)))
    met = met.where(F.exists("entities", fits))
    for key in ("url", "id"):
        first = F.row_number().over(Window.partitionBy("symbol", key).orderBy("position"))
        met = met.withColumn("__k", first).where("__k = 1")
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("published_at"), "position"))
    return met.withColumn("place", newest).where(F.col("place") <= most).select("symbol", "place", "id", "url", "title", "published_at")
