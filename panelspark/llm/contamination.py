"""Benchmark decontamination: size-partitioned MinHash containment search.

A short test item inside a long document has a small similarity to it but a large
containment, so a sketch of the document can't be as short as one for similarity. The
search turns it round. An item of q shingles is contained if c = ceil(0.75 q) of them are
in the document; of any q - c + 1 of its shingles, one at least then is. So an item's
MinHash sketch is its q - c + 1 least hashes, a quarter of its shingles, and no contained
item is missed. Items are partitioned by size, in powers of two; a partition's bound is
the greatest hash of its sketches, and only hashes up to the greatest bound of the
partitions that a document is long enough for are looked up. Candidates are verified by
exact containment of the shingles themselves. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .shingles import with_shingle_texts, with_shingles

PERCENT = 75


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, band, least, h) of (item_id, item_text): the sketch, the item's size
    partition, and how many shingles hold it at least."""
    # the outer form: a filter on the array's size would be pushed down, and with it the array
    # into its own lambdas
    rows = with_shingles(items, "item_text", "s").withColumn("s", F.array_distinct("s"))
    rows = rows.withColumns({"least": F.ceil(F.size("s") * percent / 100).cast("int"), "band": F.floor(F.log2(F.size("s").cast("double"))).cast("int")})
    return rows.select("item_id", "band", "least", F.explode_outer(F.slice("s", F.lit(1), F.size("s") - F.col("least") + 1)).alias("h")).where("h IS NOT NULL AND least > 0")


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): the items of which ``percent`` or more of the
    distinct shingles are in the document. Items' sketches are written first, and
    broadcast only if their size is under Spark's threshold; else both sides are
    shuffled by hash, and hot hashes split. What comes to the driver is a bound for each
    size partition, some thirty at most. Null or blank texts contain nothing and are
    contained in nothing; a null item_id or doc_id is one like any other; rows that share
    a doc_id or an item_id are searched each, and equal results given once; a share of
    exactly ``percent`` counts; other columns are left out; if either table is empty, so
    is the result."""
    items = items.select("item_id", F.col("text").alias("item_text"))
    asked = table(sketches(items, percent))
    bounds = sorted(tuple(r) for r in asked.groupBy("band").agg(F.min("least"), F.max("h")).collect())
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    held = with_shingles(held, "text", "s")
    rows = held.select("doc_id", "row", F.size("s").alias("n"), F.explode_outer("s").alias("h"))
    # what a document of n shingles looks up: bounds of partitions it can hold items of
    low = F.lit(-(1 << 63))
    top = F.greatest(low, low, *[F.when(F.col("n") >= least, F.lit(h)) for _, least, h in bounds])
    rows = rows.where(F.col("h") <= top)
    found = rows.join(asked, (rows["h"] == asked["h"]) & (F.col("n") >= F.col("least"))).select("doc_id", "row", "item_id").distinct()
    found = table(found)
    # a document's shingles are made once, whatever the number of items it may hold
    wanted = found.groupBy("doc_id", "row").agg(F.collect_list("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("some_null"))
    wanted = wanted.withColumn("ids", F.when(F.col("some_null"), F.array_append("ids", F.lit(None).cast("bigint"))).otherwise(F.col("ids"))).toDF("d", "r", "ids", "some_null")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["row"] == F.col("r"))).select("doc_id", "text", "ids")
    pairs = with_shingle_texts(texts, "text", "have").select("doc_id", "have", F.explode("ids").alias("i"))
    asked_texts = with_shingle_texts(items, "item_text", "want")
    pairs = pairs.join(asked_texts, F.col("i").eqNullSafe(F.col("item_id")))
    pairs = pairs.select("doc_id", "item_id", F.size("want").cast("bigint").alias("n_item"), F.size(F.array_intersect("want", "have")).cast("bigint").alias("n_common"))
    return pairs.where((F.col("n_common") > 0) & (F.col("n_common") * 100 >= F.col("n_item") * percent)).distinct()


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM v WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_common
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 100 >= 75 * any_value(n_item)"""
