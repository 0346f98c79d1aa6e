"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder, and the next stage reads that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import contamination, jaccard, language, mixing, sharding
from panelspark.llm.common import read, release, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_row(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, ``__row``: its doc_id, or, if ids are null or come
    twice, its number in the order of ids (null last) and the other columns."""
    docs = docs.select(COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("__row", F.col("doc_id"))
    order = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "source", "lang")
    return table(order.withColumn("__row", F.monotonically_increasing_id()))


def keyed_by_row(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("__row")).select(COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter go, and those of which most fits no language."""
    return language.keep(docs.select(COLUMNS), language.train_on(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked rows, that with the smallest doc_id stays, and one of rows that repeat a
    doc_id and its text."""
    rows = by_row(docs)
    _, found = jaccard.links(keyed_by_row(rows))
    gone = table(found.where("node <> component").select(F.col("node").alias("__row")))
    # texts without a word are linked with nothing
    again = rows.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull())
    again = again.groupBy("doc_id", "text").agg(F.min("__row").alias("least"), F.collect_list("__row").alias("all"))
    again = again.where(F.size("all") > 1).select(F.explode(F.filter("all", lambda r: r != F.col("least"))).alias("__row"))
    return rows.join(table(gone.unionByName(again)), "__row", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go."""
    rows = by_row(docs)
    found = contamination.contained(keyed_by_row(rows), read(spark, sf_dir, "benchmark"))
    return rows.join(table(found.select(F.col("doc_id").alias("__row")).distinct()), "__row", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each drawn block: a document may come twice; a block that the target
    cuts stays if the mix takes half of it or more. Texts stay in their tasks, and each
    task's rows leave it in the order of their shards and their shuffled places there.
    Rows without a word aren't drawn; a null source is one of its own."""
    rows = by_row(docs)
    keyed = rows.withColumns({"__id": F.col("doc_id"), "doc_id": F.col("__row")})
    return mixing.draw(keyed).sortWithinPartitions("shard", "place").withColumn("doc_id", F.col("__id")).select(COLUMNS)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs.select(COLUMNS))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The models of the first stage are beyond SQL; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
