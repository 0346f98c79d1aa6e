"""Provider payloads to rows: index lists, factor texts, observations, filings, nested
chains, short interest, first-of keys. Each takes a DataFrame with a text column and works
on all payloads at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Known item codes of current reports and what they tell: fixed values.
ITEM_TYPES = {
    "1.01": "m&a", "1.02": "m&a", "2.01": "m&a", "2.02": "earnings", "2.03": "financing", "3.01": "listing", "3.02": "financing", "4.01": "auditor",
    "4.02": "restatement", "5.01": "control", "5.02": "management", "5.03": "routine", "5.07": "routine", "7.01": "reg_fd", "8.01": "routine",
}
#: Of several types the first in this order names the filing; routine ones never do.
TYPE_ORDER = ("restatement", "control", "listing", "m&a", "auditor", "management", "earnings", "financing", "reg_fd")
HIGH_IMPACT = ("4.01", "4.02", "5.01", "2.01", "3.01")
FORMS = ("8-K", "8-K/A")


def index_members(lists: DataFrame, text: str, bounds: tuple[int, int]) -> DataFrame:
    """Rows of each index list: symbol, name without its share class, sector, the list's
    size, and whether that lies in ``bounds``."""
    shape = "data struct<data: struct<rows: array<struct<symbol: string, companyName: string, sector: string>>>>"
    rows = F.filter(F.col("__p.data.data.rows"), lambda r: r["symbol"].isNotNull())
    out = lists.withColumn("__p", F.from_json(text, shape)).withColumn("__rows", rows).withColumn("size", F.size("__rows"))
    out = out.select(*lists.drop(text).columns, "size", F.col("size").between(*bounds).alias("plausible"), F.inline("__rows"))
    name = F.trim(F.regexp_replace(F.coalesce("companyName", F.lit("")), r"\s+Common Stock$", ""))
    return out.withColumns({"symbol": F.upper(F.trim("symbol")), "name": name, "sector": F.trim(F.coalesce("sector", F.lit("")))}).drop("companyName")


def factor_rows(lines: DataFrame, text: str, names: list[str]) -> DataFrame:
    """Daily rows of a factor text (lines that start with eight digits), per cent to
    decimals; what stands before and after them has other starts."""
    parts = F.split(F.trim(text), r"[,\s]+")
    rows = lines.where(F.col(text).rlike(r"^\s*\d{8}[,\s]")).withColumn("__p", parts).where(F.size("__p") > len(names))
    return rows.select(F.to_date(F.get("__p", F.lit(0)), "yyyyMMdd").alias("date"), *[(F.get("__p", F.lit(i + 1)).cast("double") / 100).alias(c) for i, c in enumerate(names)])


def observations(payloads: DataFrame, text: str) -> DataFrame:
    """(date, value) of observation payloads; "." and empty values are missing."""
    rows = payloads.select(F.explode(F.from_json(text, "observations array<struct<date: string, value: string>>")["observations"]).alias("o"))
    return rows.select(F.to_date("o.date").alias("date"), F.expr("try_cast(o.value AS DOUBLE)").alias("value")).where("value IS NOT NULL")


def filings(payloads: DataFrame, text: str, key: str, most: int = 20) -> DataFrame:
    """Current reports from feeds of parallel arrays: form, filed, items (known codes, each
    once, as they come), high_impact, event_type; the latest ``most`` of each key."""
    shape = "filings struct<recent: struct<form: array<string>, filingDate: array<string>, accessionNumber: array<string>, items: array<string>>>"
    recent = F.from_json(text, shape)["filings"]["recent"]
    rows = payloads.select(key, F.inline(F.arrays_zip(*[recent[c].alias(c) for c in ("form", "filingDate", "accessionNumber", "items")])))
    rows = rows.where(F.col("form").isin(*FORMS)).withColumn("filed", F.to_date("filingDate"))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("filed"), F.desc("accessionNumber")))
    rows = rows.withColumn("__k", newest).where(F.col("__k") <= most)
    known = F.array(*map(F.lit, ITEM_TYPES))
    found = F.filter(F.array_distinct(F.split(F.coalesce("items", F.lit("")), r"[,;\s]+")), lambda x: F.array_contains(known, x))
    rows = rows.withColumn("found", found)
    types = F.transform("found", lambda x: F.element_at(F.create_map(*[F.lit(v) for kv in ITEM_TYPES.items() for v in kv]), x))
    first = F.get(F.filter(F.array(*map(F.lit, TYPE_ORDER)), lambda t: F.array_contains(types, t)), F.lit(0))
    return rows.select(key, F.col("accessionNumber").alias("accession"), "form", "filed", F.concat_ws(",", "found").alias("items"), F.arrays_overlap("found", F.array(*map(F.lit, HIGH_IMPACT))).alias("high_impact"), first.alias("event_type"))


def long_chain(payloads: DataFrame, text: str, key: str, most: int = 8) -> DataFrame:
    """Nested chains to one row a contract: calls and puts, no expired ones, the first
    ``most`` expiries."""
    side = "array<struct<contract: bigint, strike: double, iv: double, oi: bigint>>"
    rows = payloads.select(key, F.inline(F.from_json(text, f"options array<struct<dte: int, calls: {side}, puts: {side}>>")["options"])).where("dte >= 0")
    parts = [rows.select(key, "dte", F.lit(cp).alias("cp"), F.inline(c)) for cp, c in (("C", "calls"), ("P", "puts"))]
    both = parts[0].unionByName(parts[1])
    return both.withColumn("k", F.dense_rank().over(Window.partitionBy(key).orderBy("dte"))).where(F.col("k") <= most).drop("k")


def short_interest(payloads: DataFrame, text: str, key: str) -> DataFrame:
    """Shares short, days to cover, and the change on the month before as a fraction; rows
    that report neither shares nor a share of the float are left out."""
    p = payloads.select(key, F.from_json(text, "sharesShort double, sharesShortPriorMonth double, shortPercentOfFloat double, shortRatio double").alias("p")).select(key, "p.*")
    change = F.when(F.col("sharesShortPriorMonth") != 0, F.try_divide(F.col("sharesShort") - F.col("sharesShortPriorMonth"), F.col("sharesShortPriorMonth")))
    p = p.where("sharesShort IS NOT NULL OR shortPercentOfFloat IS NOT NULL")
    return p.select(key, F.col("sharesShort").alias("shares_short"), F.col("shortPercentOfFloat").alias("pct_float"), F.col("shortRatio").alias("days_to_cover"), F.round(change, 4).alias("change"))


def first_feed(feeds: list[DataFrame], by: str) -> DataFrame:
    """Of several feeds of one shape, all rows of the first that has any, for each key."""
    rows = feeds[0].withColumn("feed", F.lit(1))
    for i, f in enumerate(feeds[1:], 2):
        rows = rows.unionByName(f.withColumn("feed", F.lit(i)))
    return rows.withColumn("__f", F.min("feed").over(Window.partitionBy(by))).where("feed = __f").drop("__f")


def first_of(text: str, *keys: str) -> Column:
    """The first of the JSON keys that has a value."""
    return F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in keys])


def risk_free(first: Column, second: Column, otherwise: float = 4.5) -> tuple[Column, Column]:
    """(rate, label): the first series that lies between 0 and 25 per cent, else a constant."""
    ok = lambda c: c.between(0, 25)
    return F.when(ok(first), first).when(ok(second), second).otherwise(F.lit(otherwise)) / 100, F.when(ok(first), "bill").when(ok(second), "funds").otherwise("fallback")
