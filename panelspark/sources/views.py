"""Panel views over the given tables: bars, benchmark, sectors, fundamentals, actions,
timelines, prints, option chains. Each has the same definition as SQL in ``CTE``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("trade_date")


def by_date() -> WindowSpec:
    return Window.partitionBy("trade_date")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(number: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(number.cast("string"), 6, "0"))


def customer_symbol(spark: SparkSession, sf_dir: str, customer: str) -> Column:
    """The symbol that a customer's events are bound to: suppliers in turn."""
    return symbol_of(F.col(customer) % read(spark, sf_dir, "supplier").agg(F.count("*")).scalar())


def priced(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Lines as prices; dealt out by a column first, if one is given, as they were read: a line's
    own columns are fewer than what is made of them."""
    lines = read(spark, sf_dir, "lineitem").select(symbol_of(F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    if by:
        lines = lines.repartition(by)
    return lines.select(
        "symbol", "trade_date", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").alias("quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("turn"),
    )


def ohlcv(rows: DataFrame, *keys: str) -> DataFrame:
    """Bars from priced rows; money is summed in whole cents, so any order of rows gives
    the same bits."""
    return rows.groupBy(*keys).agg(
        F.min_by("price", "turn").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        (F.sum("cents") / F.sum("quantity") / 100).alias("close"), F.sum("quantity").cast("bigint").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, trade_date, open, high, low, close, volume). A symbol's lines come together, so
    that windows and groups by symbol need no shuffle of their own."""
    return ohlcv(priced(spark, sf_dir, "symbol"), "symbol", "trade_date")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_date, close, volume) of all symbols pooled."""
    return ohlcv(priced(spark, sf_dir), "trade_date").select("trade_date", "close", "volume")


def with_returns(bars: DataFrame) -> DataFrame:
    """Adds prev_close, ret, log_ret and rn (the session's number) on one window."""
    prev = F.lag("close").over(by_symbol())
    return bars.withColumns({"prev_close": prev, "ret": F.try_divide("close", prev) - 1, "log_ret": F.ln(F.try_divide("close", prev)), "rn": F.row_number().over(by_symbol())})


def bench_returns(bench: DataFrame) -> DataFrame:
    """(trade_date, bench_ret); the benchmark is one series, a row a date."""
    w = Window.partitionBy(F.lit(1)).orderBy("trade_date")
    return bench.select("trade_date", (F.col("close") / F.lag("close").over(w) - 1).alias("bench_ret"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, industry) from supplier numbers, regions and nations."""
    n = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    n = n.join(region, F.col("n") % 5 == F.col("r_regionkey")).join(nation, F.col("n") % 25 == F.col("n_nationkey"))
    return n.select(symbol_of(F.col("n")).alias("symbol"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, sector, industry, multiple): customers and their balances."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").alias("industry"), F.col("c_acctbal").alias("multiple"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(action_id, entity_id, action_type, effective_date, status, amount)."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("action_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("action_type"),
        F.to_date("o_orderdate").alias("effective_date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
    )


def timeline(actions: DataFrame) -> DataFrame:
    """(entity_id, action_id, action_type, valid_from, valid_to): each action holds until
    the entity's next; the last until 9999-12-31."""
    w = Window.partitionBy("entity_id").orderBy("effective_date", "action_id")
    to = F.coalesce(F.lead("effective_date").over(w), F.lit("9999-12-31").cast("date"))
    return actions.select("entity_id", "action_id", "action_type", F.col("effective_date").alias("valid_from"), to.alias("valid_to"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, event_type, value, size): size from the JSON props."""
    return read(spark, sf_dir, "events").withColumn("size", F.get_json_object("props", "$.k").cast("bigint")).drop("props")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option rows: underlying, strike, dte, cp, iv, last, bid, ask, oi, volume, spot."""
    part = read(spark, sf_dir, "part")
    traded = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("oi"), F.sum("l_quantity").cast("bigint").alias("volume"))
    k = F.col("p_partkey")
    rows = part.join(traded, k == F.col("l_partkey"), "left").select(
        k.alias("contract"), F.col("p_brand").alias("underlying"), F.lit(100.0).alias("spot"), (50.0 + 2.0 * F.col("p_size")).alias("strike"), (7 * (1 + k % 8)).cast("int").alias("dte"),
        F.when(F.expr("(p_partkey div 8) % 2") == 0, "C").otherwise("P").alias("cp"), (0.1 + (k % 40) / 100.0).alias("iv"),
        F.coalesce("oi", F.lit(0)).alias("oi"), F.coalesce("volume", F.lit(0)).alias("volume"),
    )
    inner = F.greatest(F.lit(0.0), F.when(F.col("cp") == "C", F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot")))
    rows = rows.withColumn("last", inner + 0.05 * (1 + F.col("contract") % 60))
    return rows.withColumns({"bid": F.col("last") * 0.98, "ask": F.col("last") * 1.03})


def dated_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain's rows once a quarter in which the contract is traded, with that quarter's
    interest and volume; as_of is its last day, and the underlying's name carries it."""
    day = F.date_sub(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 3), 1)
    traded = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("contract"), day.alias("as_of")).agg(F.count("*").alias("oi"), F.sum("l_quantity").cast("bigint").alias("volume"))
    rows = chain(spark, sf_dir).drop("oi", "volume").join(traded, "contract")
    return rows.withColumn("underlying", F.concat_ws("|", "underlying", F.col("as_of").cast("string")))


CTE = {
    "bars": """bars AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, l_shipdate::DATE AS trade_date,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  sum(round(l_extendedprice * 100)::BIGINT) / sum(l_quantity) / 100 AS close, sum(l_quantity)::BIGINT AS volume
  FROM lineitem GROUP BY 1, 2)""",
    "bench": """bench AS (SELECT l_shipdate::DATE AS trade_date, sum(round(l_extendedprice * 100)::BIGINT) / sum(l_quantity) / 100 AS close FROM lineitem GROUP BY 1)""",
    "r": """r AS (SELECT *, lag(close) OVER w AS prev_close, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS log_ret, row_number() OVER w AS rn
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))""",
    "br": "br AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS bench_ret FROM bench)",
    "sectors": """sectors AS (SELECT 'S' || lpad(n::VARCHAR, 6, '0') AS symbol, r_name AS sector, n_name AS industry
  FROM (SELECT s_suppkey AS n FROM supplier) JOIN region ON n % 5 = r_regionkey JOIN nation ON n % 25 = n_nationkey)""",
    "fundamentals": "fundamentals AS (SELECT c_custkey AS company, c_mktsegment AS sector, c_nationkey AS industry, c_acctbal AS multiple FROM customer)",
    "actions": """actions AS (SELECT o_orderkey AS action_id, o_custkey AS entity_id, o_orderpriority AS action_type, o_orderdate::DATE AS effective_date, o_orderstatus AS status, o_totalprice AS amount FROM orders)""",
    "timeline": """timeline AS (SELECT entity_id, action_id, action_type, effective_date AS valid_from,
  coalesce(lead(effective_date) OVER (PARTITION BY entity_id ORDER BY effective_date, action_id), DATE '9999-12-31') AS valid_to FROM actions)""",
    "prints": "prints AS (SELECT event_id, ts, user_id, event_type, value, (props::JSON ->> 'k')::BIGINT AS size FROM events)",
    "chain": """chain0 AS (SELECT p_partkey AS contract, p_brand AS underlying, 100.0::DOUBLE AS spot, (50.0 + 2.0 * p_size)::DOUBLE AS strike, (7 * (1 + p_partkey % 8))::INT AS dte,
  CASE WHEN (p_partkey // 8) % 2 = 0 THEN 'C' ELSE 'P' END AS cp, 0.1::DOUBLE + (p_partkey % 40) / 100.0::DOUBLE AS iv, coalesce(oi, 0)::BIGINT AS oi, coalesce(volume, 0)::BIGINT AS volume
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS oi, sum(l_quantity) AS volume FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
 chain1 AS (SELECT *, greatest(0.0::DOUBLE, CASE WHEN cp = 'C' THEN spot - strike ELSE strike - spot END) + 0.05::DOUBLE * (1 + contract % 60) AS last FROM chain0),
 chain AS (SELECT *, last * 0.98::DOUBLE AS bid, last * 1.03::DOUBLE AS ask FROM chain1)""",
}
NEEDS = {"r": ("bars",), "br": ("bench",), "timeline": ("actions",)}


CUSTOMER = "'S' || lpad((o_custkey % (SELECT count(*) FROM supplier))::VARCHAR, 6, '0')"


def sql(*views: str, body: str, ctes: str = "", recursive: bool = False) -> str:
    """``body`` with the named views, and further CTEs, before it."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, ()):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([CTE[v] for v in order] + ([ctes] if ctes else [])) + "\n" + body
