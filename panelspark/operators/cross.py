"""Cross-sectional analytics: ranks, percentiles, pairs, breadth, signal evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.rolling import YEAR, rounded, tidy
from panelspark.sources.views import by_date, by_symbol, with_returns


FREE = 0.04


BLOCK = 256
PAIRS = "a string, b string, n bigint, c double, sx double, sy double"


def _dense(symbols, sizes, days, values, dates: np.ndarray) -> np.ndarray:
    """A block's matrix: a row a date, a column a symbol, not-a-number where it has none."""
    m = np.full((len(dates), len(symbols)), np.nan)
    m[np.searchsorted(dates, days), np.repeat(np.arange(len(symbols)), sizes)] = values
    return m


def block_pairs(rows: DataFrame, value: str, products, schema: str, symbols: DataFrame | None = None) -> DataFrame:
    """``products`` of each two blocks of symbols of a group, each unordered pair once, from
    rows (grp: from 0, symbol, trade_date, value). It gets two matrices over the same dates,
    and gives arrays that go by their columns, and which of the pairs stay. Symbols are dealt
    into blocks of some BLOCK, and a block is one row. Pairs of blocks are a Cartesian product,
    so every value is written once, and read by each task that meets it. ``symbols``: (grp,
    symbol) of all rows or more, for the number of blocks, where they are known without the rows."""
    most = (rows if symbols is None else symbols).groupBy("grp").agg(F.count_distinct("symbol").alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-most // BLOCK)
    own = rows.where("grp IS NOT NULL AND symbol IS NOT NULL").groupBy("grp", "symbol").agg(F.collect_list(F.unix_date("trade_date")).alias("d"), F.collect_list(value).alias("v"))
    own = own.withColumn("id", F.col("grp") * blocks + F.pmod(F.xxhash64("symbol"), F.lit(blocks)))
    b = own.groupBy("id").agg(F.collect_list("symbol").alias("symbols"), F.collect_list(F.size("d")).alias("sizes"), F.flatten(F.collect_list("d")).alias("days"), F.flatten(F.collect_list("v")).alias("values"))
    x, y = (b.where("id IS NOT NULL").select(*[F.col(c).alias(f"{c}_{k}") for c in b.columns]) for k in "xy")
    both = x.join(y, (F.col("id_x") <= F.col("id_y")) & (F.col("id_y") < (F.floor(F.col("id_x") / blocks) + 1) * blocks))

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                p = {c: batch.column(c)[n].values for c in batch.schema.names if not c.startswith("id_")}
                one, other = ({c: p[f"{c}_{k}"].to_numpy() for c in ("sizes", "days", "values")} for k in "xy")
                dates = np.union1d(one["days"], other["days"])
                both = pa.concat_arrays([p["symbols_x"], p["symbols_y"]])
                rank = np.unique(np.asarray(both.to_pylist(), dtype=object), return_inverse=True)[1]
                stay, columns, swapped = products(*(_dense(range(len(m["sizes"])), *m.values(), dates) for m in (one, other)))
                i, j = np.nonzero(stay)
                left, right = i, j + len(one["sizes"])
                if batch.column("id_x")[n] == batch.column("id_y")[n]:
                    keep = rank[left] <= rank[right]
                    i, j, left, right = i[keep], j[keep], left[keep], right[keep]
                turn = rank[left] > rank[right]
                out = [both.take(pa.array(np.where(turn, right, left))), both.take(pa.array(np.where(turn, left, right)))]
                out += [pa.array(np.where(turn, columns[swapped.get(k, k)][i, j], m[i, j])) for k, m in columns.items()]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", *columns])

    return both.mapInArrow(run, schema)


def pairwise(bars: DataFrame, least: int = 60, symbols: DataFrame | None = None) -> DataFrame:
    """(a, b, n, correlation, covariance) of each pair of symbols, a <= b, from returns on
    common dates; covariance is annualised. Pairs of blocks are products of matrices, so no
    row is made for a pair and date. A symbol without any spread has no correlation."""

    def products(x: np.ndarray, y: np.ndarray):
        with np.errstate(all="ignore"):
            a, b = (np.nan_to_num(m - np.nansum(m, axis=0) / np.sum(~np.isnan(m), axis=0)) for m in (x, y))
        m, k = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
        n, sx, sy = m.T @ k, a.T @ k, m.T @ b
        over = np.maximum(n, 1)
        cov, vx, vy = a.T @ b - sx * sy / over, (a * a).T @ k - sx * sx / over, m.T @ (b * b) - sy * sy / over
        less = np.maximum(n - 1, 1)
        return n >= least, {"n": n.astype(np.int64), "c": cov / less, "sx": np.sqrt(np.maximum(vx, 0) / less), "sy": np.sqrt(np.maximum(vy, 0) / less)}, {"sx": "sy", "sy": "sx"}

    r = with_returns(bars).where("ret IS NOT NULL").select(F.lit(0).alias("grp"), "symbol", "trade_date", "ret")
    g = block_pairs(r, "ret", products, PAIRS, symbols)
    return tidy(g, "a", "b", "n", correlation=F.try_divide("c", F.col("sx") * F.col("sy")), covariance=F.col("c") * 252)


def common_moves(rows: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(a, b, n, together) of each pair a < b of a group's symbols with a common date: dates in
    common, and those of one direction; from rows (grp, symbol, trade_date, ret)."""

    def products(x: np.ndarray, y: np.ndarray):
        n = (~np.isnan(x)).astype(float).T @ (~np.isnan(y)).astype(float)
        together = sum((np.sign(x) == s).astype(float).T @ (np.sign(y) == s).astype(float) for s in (-1, 0, 1))
        return n > 0, {"n": n.astype(np.int64), "together": together.astype(np.int64)}, {}

    return block_pairs(rows, "ret", products, "a string, b string, n bigint, together bigint", symbols).where("a < b")


def percentile_rank(df: DataFrame, value: str, by: list[str], method: str, least: int = 1) -> Column:
    """The value's percentile among ``by``; null values have none. mean: those below and
    half of the equal; rank: those below or equal; strict: those below; peer: those below
    over n - 1; pool: as rank, from 0 to 1."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    below = F.rank().over(w.orderBy(F.asc_nulls_last(value))) - 1
    same = F.count(value).over(Window.partitionBy(*by, value))
    p = {"mean": 100 * (below + 0.5 * same) / n, "rank": 100 * (below + same) / n, "strict": 100 * below / n, "peer": F.try_divide(100.0 * below, n - 1), "pool": (below + same) / n}[method]
    return F.when(F.col(value).isNotNull() & (n >= least), p)


def breadth(bars: DataFrame, n: int = 50) -> DataFrame:
    r = with_returns(bars).withColumn("sma", F.avg("close").over(by_symbol().rowsBetween(-(n - 1), 0)))
    g = r.groupBy("trade_date").agg(
        F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("close") > F.col("sma")).alias("above_sma"), F.count_if(F.col("ret") > 0).alias("advancers"),
        F.count_if(F.col("ret") < 0).alias("decliners"), F.count_if(F.col("ret") == 0).alias("unchanged"),
    )
    return g.withColumn("net", F.col("advancers") - F.col("decliners")).withColumn("pct_above", F.round(100 * F.col("above_sma") / F.col("symbols"), 6))


def _year_sums(rows: Column, value: str, powers: int) -> Column:
    """(n, s1, s2, ...) of the rows' values and their powers, summed in the rows' order."""
    zero = F.struct(F.lit(0.0).alias("n"), *[F.lit(0.0).alias(f"s{i}") for i in range(1, powers + 1)])

    def add(s: Column, r: Column) -> Column:
        x = power = r[value]
        sums = []
        for i in range(1, powers + 1):
            sums.append((s[f"s{i}"] + power).alias(f"s{i}"))
            power = power * x
        return F.struct((s["n"] + 1).alias("n"), *sums)

    return F.aggregate(F.filter(rows, lambda r: r[value].isNotNull()), zero, add)


def _spread(rows: Column, start: Column) -> Column:
    """(n, mean, m2) of the rows' returns after those of ``start``, updated row by row."""

    def add(s: Column, r: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (r["ret"] - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (r["ret"] - mean) * (r["ret"] - s["mean"])).alias("m2"))

    return F.aggregate(F.filter(rows, lambda r: r["ret"].isNotNull()), start, add)


def _co_spread(rows: Column) -> Column:
    """(n, x, y, c, m2) of benchmark (x) and returns (y): means, co-moment, and x's own."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "c", "m2")])

    def add(s: Column, r: Column) -> Column:
        n, dx = s["n"] + 1, r["bench_ret"] - s["x"]
        x, y = s["x"] + dx / n, s["y"] + (r["ret"] - s["y"]) / n
        return F.struct(n.alias("n"), x.alias("x"), y.alias("y"), (s["c"] + dx * (r["ret"] - y)).alias("c"), (s["m2"] + (r["bench_ret"] - x) * dx).alias("m2"))

    return F.aggregate(F.filter(rows, lambda r: r["ret"].isNotNull() & r["bench_ret"].isNotNull()), zero, add)


def _worst(rows: Column) -> Column:
    """(peak, dd): the greatest close, and the least close over the peak so far, less 1."""
    none = F.lit(None).cast("double")

    def add(s: Column, r: Column) -> Column:
        peak = F.greatest(s["peak"], r["close"])
        return F.struct(peak.alias("peak"), F.least(s["dd"], r["close"] / peak - 1).alias("dd"))

    return F.aggregate(rows, F.struct(none.alias("peak"), none.alias("dd")), add)


def metric_vector(bars: DataFrame, bench_ret: DataFrame) -> DataFrame:
    """One row a symbol: volatilities, one-year drawdown, moments, value at risk, 12-1
    momentum, beta and Amihud illiquidity; null where history is too short. A symbol's bars
    are one array, the latest first, and sums go along it: their last bits, which show in the
    sixth decimal of a great value, don't hang on the order in which rows arrive."""
    r = with_returns(bars.join(bench_ret, "trade_date", "left"))
    traded = F.col("close") * F.col("volume")
    illiquidity = F.when(traded > 0, F.abs("ret") / traded * 1e6).alias("illiquidity")
    g = r.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("trade_date", "close", "ret", "bench_ret", illiquidity)), asc=False).alias("bars"))
    g = g.select("symbol", "bars", F.slice("bars", 1, 252).alias("year"))
    state = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mean", "m2")])
    done = 0
    for n in (21, 63, 252):  # a longer volatility goes on from the shorter one
        g = g.withColumn(f"s{n}", _spread(F.slice("bars", done + 1, n - done), state))
        state, done = F.col(f"s{n}"), n
    g = g.withColumns({"s": _spread(F.slice("bars", done + 1, F.size("bars")), state), "sums": _year_sums(F.col("year"), "ret", 4), "illiquid": _year_sums(F.col("year"), "illiquidity", 1), "co": _co_spread(F.col("year"))})
    g = g.withColumns({"sorted": F.sort_array(F.filter(F.transform("year", lambda b: b["ret"]), lambda x: x.isNotNull())), "dd": _worst(F.reverse("year"))["dd"]})
    vol = lambda s: F.sqrt(F.when(s["n"] > 1, s["m2"] / (s["n"] - 1))) * YEAR * 100
    m, m2, m3, m4 = (F.try_divide(F.col("sums")[f"s{i}"], F.col("sums")["n"]) for i in range(1, 5))
    v = F.try_divide(F.col("s252")["m2"], F.col("s252")["n"])
    co, at = F.col("co"), (F.size("sorted") - 1) * F.lit(0.05)
    part = at - F.floor(at)
    quantile = F.get("sorted", F.floor(at).cast("int")) * (1 - part) + F.get("sorted", F.ceil(at).cast("int")) * part
    values = {f"vol_{n}d": vol(F.col(f"s{n}")) for n in (21, 63, 252)} | {
        "annualised_vol": vol(F.col("s")),
        "max_drawdown": F.col("dd") * 100,
        "var_95": -100 * quantile,
        "beta": F.when(co["n"] > 1, F.try_divide(co["c"] / (co["n"] - 1), co["m2"] / (co["n"] - 1))),
        "skewness": F.try_divide(m3 - 3 * m * m2 + 2 * m * m * m, F.pow(v, F.lit(1.5))),
        "kurtosis": F.try_divide(m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m, v * v) - 3,
        "momentum_12_1": 100 * (F.try_divide(F.get("bars", F.lit(21))["close"], F.get("bars", F.lit(252))["close"]) - 1),
        "amihud": F.try_divide(F.col("illiquid")["s1"], F.col("illiquid")["n"]) * 1e3,
    }
    out = g.select("symbol", F.size("bars").cast("bigint").alias("n"), *[c.alias(k) for k, c in values.items()])
    return rounded(out, 6, *values)


METRICS = ("vol_21d", "vol_63d", "vol_252d", "annualised_vol", "max_drawdown", "var_95", "beta", "skewness", "kurtosis", "momentum_12_1", "amihud")


def long_metrics(vector: DataFrame, sectors: DataFrame) -> DataFrame:
    """(symbol, sector, metric, value)."""
    return vector.unpivot("symbol", list(METRICS), "metric", "value").where("value IS NOT NULL").join(sectors.select("symbol", "sector"), "symbol", "left")


def rank_ic(panel: DataFrame, signal: str, forward: str, least: int = 10) -> DataFrame:
    """Spearman correlation of signal and forward return on each date, ties averaged;
    0 if either is constant; dates with fewer than ``least`` names are left out."""
    p = panel.where(F.col(signal).isNotNull() & F.col(forward).isNotNull())

    def mean_rank(c: str) -> Column:
        return F.rank().over(by_date().orderBy(c)) + (F.count("*").over(Window.partitionBy("trade_date", c)) - 1) / 2

    p = p.select("trade_date", mean_rank(signal).alias("x"), mean_rank(forward).alias("y"))
    g = p.groupBy("trade_date").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("s")).where(F.col("n") >= least)
    return g.select("trade_date", "n", F.round(F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(0.0), 6).alias("ic"))


def buckets(panel: DataFrame, signal: str, q: int) -> DataFrame:
    """Adds bucket 1..q: of the k-th of n by signal (ties by symbol), the least b with
    (k - 1) q <= b (n - 1)."""
    p = panel.where(F.col(signal).isNotNull())
    k, n = F.row_number().over(by_date().orderBy(signal, "symbol")), F.count("*").over(by_date())
    return p.withColumns({"k": k, "n": n}).withColumn("bucket", F.greatest(F.lit(1), F.ceil((F.col("k") - 1) * q / F.greatest(F.lit(1), F.col("n") - 1)).cast("int")))


def newey_west(series: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """(n, mean, se, t) of a series by key: Bartlett weights over 4 (n / 100)^(2/9) lags."""
    w = Window.partitionBy(*by)
    s = series.where(F.col(value).isNotNull()).select(*by, order, F.col(value).alias("x"))
    s = s.withColumns({"n": F.count("*").over(w), "u": F.col("x") - F.avg("x").over(w), "k": F.row_number().over(w.orderBy(order))})
    s = s.withColumn("lags", F.least(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), F.col("n") - 1))
    s = s.withColumn("us", F.collect_list("u").over(w.orderBy(order).rowsBetween(-20, 0)))
    terms = F.transform(F.sequence(F.lit(1), F.least(F.col("lags"), F.size("us") - 1)), lambda i: 2 * (1 - i / (F.col("lags") + 1)) * F.col("u") * F.get("us", F.size("us") - 1 - i))
    own = F.when((F.col("lags") >= 1) & (F.size("us") > 1), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    g = s.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum(F.col("u") * F.col("u") + own).alias("v"))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("v"))) / F.col("n")
    return tidy(g, *by, "n", mean=F.col("mean"), se=se, t=F.try_divide("mean", se))


def perf_stats(returns: DataFrame, by: list[str], ret: str, order: str) -> DataFrame:
    """Total and annual growth, volatility, Sharpe and Sortino ratios over the risk-free
    rate, deepest drawdown, Calmar; ratios without a spread are 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = returns.where(F.col(ret) > -1).withColumn("wealth", F.exp(F.sum(F.log1p(ret)).over(w)))
    r = r.withColumn("dd", F.col("wealth") / F.max("wealth").over(w) - 1)
    below = F.when(F.col(ret) < FREE / 252, F.col(ret) - FREE / 252)
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.exp(F.sum(F.log1p(ret))).alias("w"), (F.avg(ret) - FREE / 252).alias("m"), F.stddev_samp(ret).alias("s"), F.stddev_samp(below).alias("down"), F.min("dd").alias("dd"))
    cagr = F.pow("w", 252 / F.col("n")) - 1
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return tidy(g, *by, "n", total=F.col("w") - 1, cagr=cagr, vol=F.col("s") * YEAR, sharpe=ratio("m", "s") * YEAR, sortino=ratio("m", "down") * YEAR, max_drawdown=F.col("dd"), calmar=ratio(cagr, -F.col("dd")))
