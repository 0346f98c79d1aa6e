"""Registered queries: news. Articles are the pages: language, title and address are read
from them; ids, dates and entities follow from the page's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import news
from panelspark.plans import scans  # noqa: F401  registers the SQL used here
from panelspark.registry import SQL, query
from panelspark.sources.views import read, symbol_of

NOW = "2024-01-31 00:00:00"


def items(spark, d) -> DataFrame:
    """(position, id, url, title, language, published_at, entities)."""
    pages = read(spark, d, "pages").withColumn("n", F.greatest(F.lit(1), read(spark, d, "supplier").agg(F.count("*")).scalar()))
    k = F.col("page_id")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))

    def entity(j):
        name = symbol_of((k * 7 + j) % F.col("n"))
        return F.struct(F.when(k % 5 == 0, F.lower(name)).otherwise(name).alias("symbol"), pick(("us", "DE", None), (k + j) % 3).alias("country"), pick(("X", "Y"), (k + j) % 2).alias("exchange"))

    back = F.when(k % 23 == 0, -48).otherwise(k % 240).cast("int")
    return pages.select(
        k.alias("position"), F.when(k % 17 != 0, F.concat(F.lit("n"), (k % 150).cast("string"))).alias("id"), "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"),
        F.timestamp_add("HOUR", -back, F.lit(NOW).cast("timestamp")).alias("published_at"), F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), entity).alias("entities"),
    )


def listings(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(symbol_of(k).alias("symbol"), F.when(k % 4 == 0, "US").alias("country"), F.when(k % 6 == 0, "X").alias("exchange"))


ARTICLES = f"""WITH n AS (SELECT greatest(1, count(*)) AS n FROM supplier),
i AS (SELECT page_id AS position, CASE WHEN page_id % 17 <> 0 THEN 'n' || page_id % 150 END AS id, url, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, TIMESTAMP '{NOW}' - to_hours(CASE WHEN page_id % 23 = 0 THEN -48 ELSE page_id % 240 END) AS published_at FROM pages),
e AS (SELECT page_id AS position, 'S' || lpad(((page_id * 7 + j) % n)::VARCHAR, 6, '0') AS symbol, [ 'us', 'DE', NULL ][(page_id + j) % 3 + 1] AS country, ['X', 'Y'][(page_id + j) % 2 + 1] AS exchange FROM pages, n, range(3) r(j) WHERE j <= page_id % 3),
l AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN 'US' END AS country, CASE WHEN s_suppkey % 6 = 0 THEN 'X' END AS exchange FROM supplier),
o AS (SELECT i.*, canonical FROM i JOIN ({SQL['f11_canonical_urls']}) ON page_id = position WHERE language = 'en' AND title <> '' AND id IS NOT NULL AND regexp_matches(lower(url), '^https?://[^/?#\\s]+') AND published_at <= TIMESTAMP '{NOW}' AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY),
m AS (SELECT DISTINCT l.symbol, o.* FROM o JOIN e USING (position) JOIN l ON l.symbol = e.symbol AND (l.country IS NULL OR lower(e.country) = lower(l.country)) AND (l.exchange IS NULL OR e.exchange = l.exchange)),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, canonical ORDER BY position) = 1),
v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY symbol, id ORDER BY position) = 1)
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, position)::INT AS place, id, canonical AS url, title, published_at FROM v QUALIFY place <= 500"""


@query("pf19_a46_listing_articles", ARTICLES)
def pf19(spark, d) -> DataFrame:
    return news.of_listings(items(spark, d), listings(spark, d), NOW)
