"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed unigrams and bigrams: one of the trusted documents, one of
the whole corpus. A document's score is the mean over its n-grams of the logarithm of the
ratio of the two. Ratios are whole millionths, so a sum doesn't depend on its order, and a
document is kept if its score reaches a fixed threshold: no sampling, no ranks, the same
verdict at any size of the corpus. What comes to the driver is one number a bin, 10,000 in
all, and goes back as a constant of the plan. DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, crc_sql

BINS = 10_000
#: Mean log ratio a gram, in millionths: grams 0.78 times as frequent in trusted documents.
THRESHOLD = -250_000
SCALE = 1_000_000
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: A gram's parts: runs of ASCII punctuation, and runs of all else, within words.
PARTS = r"\p{Punct}+|[^\p{Punct}\s]+"
SQL_PARTS = r"[[:punct:]]+|[^[:punct:]\x20\x09-\x0D]+"
#: A bigram's hash is the first part's, times this, and the second part's.
SPREAD = 1_000_003


def trusted(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, trusted) of documents with a label of quality 1 that none calls toxic: all, or
    about ``most`` of them, by hash, for who asks for a bounded fit; the query doesn't."""
    rows = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    rows = rows.where("q = 1 AND t = 0").select("doc_id")
    if most is not None and (n := rows.count()) > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int((1 << 32) * most / n)))
    return rows.withColumn("trusted", F.lit(1))


def with_grams(docs: DataFrame, text: str, out: str, bins: int = BINS) -> DataFrame:
    """Adds the bins of the text's unigrams and bigrams; none for null."""
    parts = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PARTS), F.lit(0))
    docs = docs.withColumn("__p", F.transform(parts, lambda x: F.crc32(x.cast("binary"))))
    one = F.transform("__p", lambda x: (x % bins).cast("int"))
    two = F.transform(F.slice("__p", F.lit(2), F.greatest(F.size("__p") - 1, F.lit(0))), lambda x, i: ((F.get("__p", i) * SPREAD + x) % bins).cast("int"))
    return docs.withColumn(out, F.concat(one, two)).drop("__p")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, trusted). The labels grow with the documents, so both sides are merged at
    any size: texts are moved once, and small tables cost what large ones do."""
    return docs.select("doc_id", "text").join(trusted(labels).hint("merge"), "doc_id", "left")


def log_ratios(docs: DataFrame, labels: DataFrame, bins: int = BINS) -> list[int]:
    """A bin's log ratio in millionths, from the grams of all documents, each count raised
    by one; zeros if no document is trusted."""
    rows = with_grams(marked(docs, labels), "text", "g", bins)
    # the outer form: a filter on the array's size would be pushed below, and the array into its own lambdas
    rows = rows.select("trusted", F.explode_outer("g").alias("bin")).where("bin IS NOT NULL")
    counts = rows.groupBy("bin").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    raw, good = [0] * bins, [0] * bins
    for r in counts.collect():  # a row a bin
        raw[r.bin], good[r.bin] = r.raw, r.good
    if not any(good):
        return [0] * bins
    shift = math.log(sum(raw) + bins) - math.log(sum(good) + bins)
    return [math.floor(SCALE * (math.log((g + 1) / (r + 1)) + shift) + 0.5) for r, g in zip(raw, good)]


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. Windows
    of three words are told apart by 64 bits, within a document; they are sorted with their
    places only where some come twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("__w", F.array_remove(F.split(text, BLANKS), ""))
    windows = F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(3)]))
    docs = docs.withColumn("__h", F.when(F.size("__w") >= 3, windows))
    docs = docs.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("__s", lambda s, i: (i > 0) & (s["h"] == F.get("__s", i - 1)["h"]) | F.coalesce(s["h"] == F.get("__s", i + 1)["h"], F.lit(False)))
    docs = docs.withColumn("__at", F.sort_array(F.transform(twice, lambda s: s["i"])))
    docs = docs.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    covered = F.aggregate(F.transform("__at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - p, F.lit(3)))), F.lit(0), lambda n, x: n + x)
    docs = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("__w", "__h", "__s", "__at", "__l")], F.size("__w").cast("bigint").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("bigint"), lambda n, x: n + F.char_length(x)).alias("word_chars"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    return docs.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def judged(docs: DataFrame, ratios: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_grams, ratio_sum), a row a row of ``docs``; ``ratio_sum`` is in millionths, and a
    document is kept if it passes the base rules and ratio_sum >= threshold * n_grams, so a
    tie keeps. Null and empty texts have no words and fail; texts of any length are read
    whole; equal rows give equal rows; a null doc_id is never trusted; other columns are
    left out; an empty table gives an empty table. Without trusted documents all ratios are
    zero, and the base rules alone decide."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # a constant of the plan
    docs = with_grams(docs.select("doc_id", "text"), "text", "__g", len(ratios))
    docs = docs.withColumns({"n_grams": F.size("__g").cast("bigint"), "ratio_sum": F.aggregate("__g", F.lit(0).cast("bigint"), lambda n, g: n + F.get(table, g))})
    docs = with_base(docs.drop("__g"))
    docs = docs.withColumn("kept", ~F.col("base_failed") & (F.col("ratio_sum") >= threshold * F.col("n_grams")))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "ratio_sum")


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, log_ratios(docs, labels))


SQL = rf"""
WITH d AS (SELECT *, row_number() OVER () AS r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l, regexp_extract_all(text, '{SQL_PARTS}') AS p FROM documents),
lw AS (SELECT r, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS t FROM d),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM t),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM c, range(3) x(j) WHERE n > 1 GROUP BY r),
w AS (SELECT p, {crc_sql("p")} AS c FROM (SELECT DISTINCT unnest(p) AS p FROM d)),
x AS (SELECT r, doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM d),
y AS (SELECT r, doc_id, c, lag(c) OVER (PARTITION BY r ORDER BY i) AS b FROM x JOIN w USING (p)),
g AS (SELECT r, doc_id, c % {BINS} AS bin FROM y UNION ALL SELECT r, doc_id, (b * {SPREAD} + c) % {BINS} FROM y WHERE b IS NOT NULL),
ok AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(coalesce(toxic, 0)) = 0),
n AS (SELECT bin, count(*) AS raw, count(ok.doc_id) AS good FROM g LEFT JOIN ok USING (doc_id) GROUP BY bin),
s AS (SELECT sum(raw) + {BINS} AS raw, sum(good) + {BINS} AS good, sum(good) AS known FROM n),
lr AS (SELECT bin, CASE WHEN known = 0 THEN 0 ELSE CAST(floor({SCALE} * (ln((n.good + 1) / (n.raw + 1)) + ln(s.raw) - ln(s.good)) + 0.5) AS BIGINT) END AS v FROM n, s),
sc AS (SELECT r, count(*) AS n_grams, CAST(sum(v) AS BIGINT) AS ratio_sum FROM g JOIN lr USING (bin) GROUP BY r),
b AS (SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars, CAST(coalesce(length(text) - length(translate(text, '{SYMBOLS}', '')), 0) AS BIGINT) AS n_symbols,
  CAST(coalesce(len(lw.l) - len(list_distinct(lw.l)), 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_grams, 0) AS BIGINT) AS n_grams, coalesce(ratio_sum, 0) AS ratio_sum
  FROM d JOIN lw USING (r) LEFT JOIN rep USING (r) LEFT JOIN sc USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND ratio_sum >= {THRESHOLD} * n_grams AS kept FROM f"""
