"""Removal of repeated line runs by a suffix array over line ids.

Prefix doubling names every suffix by the earliest place where its first 1, 2, 4, ...
lines stand; names of 2h lines come from the names of h lines at a place and h places on.
Places whose name is theirs alone drop out, as no longer prefix can repeat. Doubling ends
at the least run length: places with one name then form a longest-common-prefix interval
of that many lines or more. Every place of an interval but its earliest starts a later
copy; unions of copies are the maximal repeated runs, and they are deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .mixing import n_words
from .repeats import keyed

LEAST, WORDS = 3, 50


def named(rows: DataFrame, by: list[str]) -> DataFrame:
    """(key, dup, pos, need, name) of rows whose ``by`` isn't theirs alone; name: the
    earliest place that has it. Summed up before the shuffle; the join back can be split."""
    place = F.struct("key", "dup", "pos")
    names = rows.groupBy(*by).agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return table(rows.join(names, by).select("key", "dup", "pos", "need", F.col("least").alias("name")))


def shifted(names: DataFrame, by: int) -> DataFrame:
    """Adds the name ``by`` places on, where there is one."""
    ahead = names.select("key", "dup", (F.col("pos") - by).alias("pos"), F.col("name").alias("name2"))
    return names.join(ahead, ["key", "dup", "pos"])


def copies(lines: DataFrame, least: int = LEAST, short: bool = False) -> DataFrame:
    """(key, dup, pos, size): places of (key, dup, pos, line, need) where a run of
    ``size`` = ``least`` lines starts that also starts earlier. With ``short`` the sizes
    below count too, at places that need no more lines."""
    lines = lines.withColumns({"h1": F.md5(F.col("line").cast("binary"))}).drop("line")
    names, size = named(lines, ["h1"]), 1
    later = lambda: names.where((F.col("name") < F.struct("key", "dup", "pos")) & (F.col("need") <= size)).select("key", "dup", "pos", F.lit(size).alias("size"))
    found = []
    while size < least:
        if short:
            found.append(later())
        step = 1 if short else min(size, least - size)
        names, size = named(shifted(names, step), ["name", "name2"]), size + step
    return reduce(DataFrame.unionByName, found, later())


def needed(counts: Column, i: Column, least: int, words: int) -> Column:
    """How many lines from the ``i``-th on, ``least`` at most, have ``words`` words."""
    need = F.lit(least)
    for n in range(least - 1, 0, -1):
        need = F.when(reduce(lambda a, k: a + F.get(counts, i + k), range(1, n), F.get(counts, i)) >= words, n).otherwise(need)
    return need


def whole_copies(rows: DataFrame, least: int) -> DataFrame:
    """(key, dup, pos, size) of texts under ``least`` lines, with a word, that are also
    the whole text of an earlier row."""
    rows = rows.select("key", "dup", F.size(F.split("text", "\n")).alias("size"), F.md5(F.col("text").cast("binary")).alias("h"), n_words(F.col("text")).alias("w"))
    rows = rows.where((F.col("size") < least) & (F.col("w") > 0)).withColumns({"pos": F.lit(0), "need": F.lit(0)})
    return named(rows, ["h", "size"]).where(F.col("name") < F.struct("key", "dup", "pos")).select("key", "dup", "pos").join(rows, ["key", "dup", "pos"]).select("key", "dup", "pos", "size")


def without_copies(docs: DataFrame, least: int = LEAST, words: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text (what is left, lines joined by line feeds),
    n_lines, n_removed, n_runs. A line goes if a run of ``least`` lines that holds it
    starts at an earlier place too: in a document with a smaller doc_id, or further up.
    With ``words``, so do runs of fewer lines that have as many words, and texts of fewer
    lines that are, whole, the text of an earlier row (texts without a word stay).
    Null text counts as empty, one empty line; a null doc_id comes last; rows that share
    a doc_id come in the order of their texts; other columns are left out; an empty table
    gives an empty table."""
    rows = keyed(docs)
    if words:
        counted = rows.select("key", "dup", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), n_words(x).alias("w"))).alias("each"))
        place = F.transform("each", lambda x, i: F.struct(x["line"].alias("line"), needed(F.col("each.w"), i, least, words).alias("need")))
        lines = counted.select("key", "dup", F.posexplode(place).alias("pos", "x")).select("key", "dup", "pos", "x.*")
    else:
        lines = rows.select("key", "dup", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("need", F.lit(least))
    starts = copies(lines, least, bool(words))
    starts = table(starts.unionByName(whole_copies(rows, least)) if words else starts)
    gone = starts.select("key", "dup", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
    first = F.coalesce(F.lag("pos").over(Window.partitionBy("key", "dup").orderBy("pos")), F.lit(-2)) < F.col("pos") - 1
    gone = gone.withColumn("first", first.cast("int"))
    gone = table(gone.groupBy("key", "dup").agg(F.collect_list("pos").alias("gone"), F.sum("first").alias("n_runs")))

    # kept places by a set difference: linear in the lines of a text
    both = rows.join(gone, ["key", "dup"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return both.select(
        F.when(~F.col("null"), F.col("key")).alias("doc_id"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_runs", F.lit(0)).cast("bigint").alias("n_runs"),
    )


def digests(docs: DataFrame, words: int | None = None) -> DataFrame:
    """``without_copies`` with the SHA-256 of the text in place of it."""
    return without_copies(docs, words=words).select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT *, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS k FROM b WHERE l3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM c, (VALUES (0), (1), (2)) v(o) WHERE k > 1),
r AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -2) < pos - 1 AS first FROM g)
SELECT a.doc_id, count(*) AS n_lines, count(r.pos) AS n_removed, count(*) FILTER (r.first) AS n_runs,
       sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (r.pos IS NULL), '')) AS kept_sha256
FROM a LEFT JOIN r USING (doc_id, pos) GROUP BY a.doc_id"""

SQL_SHORT = rf"""
WITH a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM a),
b AS (SELECT *, lead(line) OVER o AS l2, lead(line, 2) OVER o AS l3, w + lead(w) OVER o AS w2 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, 3 AS size, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS k FROM b WHERE l3 IS NOT NULL
  UNION ALL SELECT doc_id, pos, 2, row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, pos) FROM b WHERE w2 >= {WORDS}
  UNION ALL SELECT doc_id, pos, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) FROM b WHERE w >= {WORDS}
  UNION ALL SELECT doc_id, 0, len(string_split(text, chr(10))), row_number() OVER (PARTITION BY text ORDER BY doc_id) FROM documents
            WHERE len(string_split(text, chr(10))) < 3 AND regexp_matches(text, '[^\x20\x09-\x0D]')),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM c, (VALUES (0), (1), (2)) v(o) WHERE k > 1 AND o < size),
r AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -2) < pos - 1 AS first FROM g)
SELECT a.doc_id, count(*) AS n_lines, count(r.pos) AS n_removed, count(*) FILTER (r.first) AS n_runs,
       sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (r.pos IS NULL), '')) AS kept_sha256
FROM a LEFT JOIN r USING (doc_id, pos) GROUP BY a.doc_id"""
