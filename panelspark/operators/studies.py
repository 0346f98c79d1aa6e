"""Event studies: sessions, abnormal returns, overlap collapse, pooling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.normal import cdf
from panelspark.operators.rolling import moment_symbols, tidy, whole_symbols
from panelspark.sources.views import with_returns


def paired_sessions(bars: DataFrame, bench_ret: DataFrame) -> DataFrame:
    """(symbol, trade_date, ret, bench_ret, sess): sessions with both returns, numbered. The
    benchmark is a row a date, so it is broadcast."""
    r = with_returns(bars).join(F.broadcast(bench_ret), "trade_date").where("ret IS NOT NULL AND bench_ret IS NOT NULL")
    return r.select("symbol", "trade_date", "ret", "bench_ret", F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")).alias("sess"))


KEYS = ("symbol", "event_type", "event_date", "after_close")


def _studied(t: pa.Table, frames: dict, least: dict, window: tuple, days: bool) -> pa.Table:
    """A row for each event that a table of whole symbols has on their first rows, with the
    frames' moments at its session, of those with as many values as ``least`` says."""
    start = np.flatnonzero(t["__k"].to_numpy() == 1)
    length = np.diff(np.append(start, t.num_rows))
    first, end = start, start + length
    events = t["events"].combine_chunks()
    own = np.repeat(np.arange(t.num_rows), pc.fill_null(pc.list_value_length(events), 0).to_numpy())
    of = np.searchsorted(start, own)
    e = events.flatten()
    on, late = e.field("event_date").cast(pa.int32()).to_numpy().astype(np.int64), e.field("after_close").to_numpy(zero_copy_only=False).astype(bool)
    date = t["trade_date"].combine_chunks().cast(pa.int32()).to_numpy().astype(np.int64)
    line = lambda k, day: (k << 33) + day + (1 << 31)  # noqa: E731  symbols one after another
    at = np.searchsorted(line(np.repeat(np.arange(len(start)), length), date), line(of, on), "right") - ~late
    there = (at >= first[of]) & (at < end[of])
    m = moment_symbols(t.drop_columns(["events"]), frames)
    for k, n in least.items():
        x = m[k].to_numpy()
        there[there] = x[at[there]] == n
    e, of, at = e.filter(pa.array(there)), of[there], at[there]
    m = m.take(pa.array(at))
    out = {"symbol": m["symbol"], **{k: e.field(k) for k in KEYS[1:]}, "session": m["trade_date"], **{k: m[k] for k in frames}}
    if days:
        lo, hi = np.maximum(first[of], at + window[0]), np.minimum(end[of], at + window[1] + 1)
        offsets = np.append(0, np.cumsum(hi - lo))
        rows = pa.array(np.repeat(lo - offsets[:-1], hi - lo) + np.arange(offsets[-1]))
        cells = pa.StructArray.from_arrays([t[c].combine_chunks().take(rows) for c in ("trade_date", "ret", "bench_ret")], ["trade_date", "ret", "bench_ret"])
        out |= {"ahead": pa.array(at - lo, pa.int32()), "days": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)}
    return pa.table(out)


def event_study(events: DataFrame, sessions: DataFrame, estimate: tuple = (-120, -21), window: tuple = (-10, 30), drift: tuple = (2, 21), days: bool = False) -> DataFrame:
    """(symbol, event_type, event_date, after_close, session, n, alpha, beta, r2, car, t, p,
    drift) of each event: market model over the estimation sessions, cumulative abnormal
    return over the window with the variance of its days' forecasts, and that of the drift
    leg. The event's session is the last at or before its date, or the first after it where
    after_close is set. Events without room for the windows are left out. The windows'
    moments are frames over a symbol's sessions, so an event is one look-up, not a row for
    each of its days; events ride on their symbol's first session, so that moments are looked up
    where they are made, and none is moved. ``days``: with the window's sessions, and how many of
    them lie ahead of the event's own, for abnormal_days."""
    names = {"ret": "ret", "bench": "bench_ret", "both": ("ret", "bench_ret"), "square": "square"}
    est, ev, dr = estimate, window, drift
    put = lambda kind, of, frame: (kind, names[of], *frame, 1)
    frames = dict(
        n=put("count", "ret", est), mx=put("avg", "bench", est), my=put("avg", "ret", est), c=put("covar_pop", "both", est), vx=put("var_pop", "bench", est), vy=put("var_pop", "ret", est),
        l=put("count", "ret", ev), sx=put("sum", "bench", ev), sy=put("sum", "ret", ev), sxx=put("sum", "square", ev), dl=put("count", "ret", dr), dx=put("sum", "bench", dr), dy=put("sum", "ret", dr),
    )
    least = {"n": estimate[1] - estimate[0] + 1, "l": window[1] - window[0] + 1}
    own = events.where("event_date IS NOT NULL AND after_close IS NOT NULL").groupBy("symbol").agg(F.collect_list(F.struct(*KEYS[1:])).alias("events")).withColumnRenamed("symbol", "__s")
    m = sessions.select("symbol", "trade_date", "ret", "bench_ret", (F.col("bench_ret") * F.col("bench_ret")).alias("square"), F.col("sess").alias("__k"))
    m = m.join(own.hint("merge"), (F.col("symbol") == F.col("__s")) & (F.col("__k") == 1), "left").drop("__s")
    kinds = {f.name: f.dataType for f in [*events.schema, *sessions.schema]}
    cells = T.ArrayType(T.StructType([T.StructField(c, kinds[c]) for c in ("trade_date", "ret", "bench_ret")]))
    schema = [*[(k, kinds[k]) for k in KEYS], ("session", kinds["trade_date"]), *[(k, T.DoubleType()) for k in frames], *([("ahead", T.IntegerType()), ("days", cells)] if days else [])]
    g = whole_symbols(m, lambda t: _studied(t, frames, least, window, days), T.StructType([T.StructField(*x) for x in schema]))
    g = g.withColumns({k: F.col(k).cast("bigint") for k in ("n", "l", "dl")})
    g = g.withColumn("beta", F.coalesce(F.try_divide("c", "vx"), F.lit(1.0))).withColumn("alpha", F.when(F.col("vx") > 0, F.col("my") - F.col("beta") * F.col("mx")).otherwise(0.0))
    g = g.withColumns({"car": F.col("sy") - F.col("l") * F.col("alpha") - F.col("beta") * F.col("sx"), "s2": F.greatest(F.lit(0.0), F.col("n") * (F.col("vy") - F.col("beta") * F.col("c"))) / (F.col("n") - 2)})
    off = F.greatest(F.lit(0.0), F.col("sxx") - 2 * F.col("mx") * F.col("sx") + F.col("l") * F.col("mx") * F.col("mx"))
    spread = off / F.greatest(F.col("n") * F.col("vx"), F.lit(1e-8))
    g = g.withColumn("t", F.col("car") / F.sqrt(F.greatest(F.lit(1e-12), F.col("s2") * (F.col("l") + F.col("l") / F.col("n") + spread))))
    late = F.when(F.col("dl") == drift[1] - drift[0] + 1, F.col("dy") - F.col("dl") * F.col("alpha") - F.col("beta") * F.col("dx"))
    return tidy(g, *KEYS, "session", "n", *(("ahead", "days") if days else ()), alpha=F.col("alpha"), beta=F.col("beta"), r2=F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy")), car=F.col("car"), t=F.col("t"), p=2 * (1 - cdf(F.abs("t"))), drift=late)


def daily_abnormal(studied: DataFrame, sessions: DataFrame, window: tuple = (-10, 30)) -> DataFrame:
    """(symbol, event_type, event_date, after_close, day, trade_date, abnormal, cumulative):
    a row for each day of each studied event's window. A symbol's sessions are one row that its
    events look into, so what is moved grows with sessions and events, not with their days."""
    at = studied.select(*KEYS, "alpha", "beta", F.col("session").alias("trade_date"))
    own = sessions.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("trade_date", "ret", "bench_ret"))).alias("s"))
    rows = at.join(own.hint("merge"), "symbol")
    t0 = F.array_position(F.col("s.trade_date"), F.col("trade_date"))
    first = F.greatest(F.lit(1), t0 + window[0])
    days = F.slice("s", first.cast("int"), (t0 + window[1] - first + 1).cast("int"))
    return abnormal_days(rows.withColumns({"t0": t0, "ahead": (t0 - first).cast("int"), "days": days}).where("t0 > 0"))


def abnormal_days(studied: DataFrame) -> DataFrame:
    """daily_abnormal's rows from events that carry their window's sessions (``days``)."""
    ar = lambda x: x["ret"] - F.col("alpha") - F.col("beta") * x["bench_ret"]
    rows = studied.select(*KEYS, "ahead", F.transform("days", lambda x: F.struct(x["trade_date"].alias("trade_date"), ar(x).alias("ar"))).alias("w"))
    sums = F.aggregate("w.ar", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))
    rows = rows.withColumn("sums", sums)
    line = F.transform("w", lambda x, i: F.struct((i - F.col("ahead")).cast("int").alias("day"), x["trade_date"].alias("trade_date"), x["ar"].alias("ar"), F.get("sums", i).alias("sum")))
    rows = rows.select(*KEYS, F.inline(line))
    return tidy(rows, *KEYS, "day", "trade_date", abnormal=F.col("ar"), cumulative=F.col("sum"))


def collapse(events: DataFrame, span: int = 60) -> DataFrame:
    """Of events of one key, those after the end of the last kept one (its end_date, or
    ``span`` days on): an ordered fold over each key's events."""
    per = events.groupBy("symbol", "event_type").agg(F.array_sort(F.collect_set(F.struct("event_date", F.coalesce("end_date", F.date_add("event_date", span)).alias("end")))).alias("e"))
    start = F.array().cast("array<struct<event_date:date,end:date>>")
    kept = F.aggregate("e", start, lambda acc, x: F.when((F.size(acc) == 0) | (x["event_date"] > F.element_at(acc, -1)["end"]), F.concat(acc, F.array(x))).otherwise(acc))
    return per.select("symbol", "event_type", F.inline(kept)).select("symbol", "event_type", "event_date", F.col("end").alias("end_date"))


def pooled(cars: DataFrame, least: int = 2) -> DataFrame:
    g = cars.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("car").alias("m"), F.stddev_samp("car").alias("s"), F.sort_array(F.collect_list("car")).alias("cars")).where(F.col("n") >= least)
    t = F.try_divide("m", F.col("s") / F.sqrt("n"))
    return tidy(g, "event_type", "n", "cars", mean=F.col("m"), sd=F.col("s"), t=t, p=2 * (1 - cdf(F.abs(t))))
