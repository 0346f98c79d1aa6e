"""Resampling and likelihood search on a symbol's own series. A group is one symbol's
sessions, which its history bounds; all replicates, or all grid points, go side by side as
columns through one pass over it, so no row is copied for them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Where Poisson(1) passes from k to k + 1.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))


def seed_of(*key) -> int:
    return zlib.crc32("|".join(map(str, key)).encode())


def weighted_quantiles(value: np.ndarray, weight: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile, interpolated, of ``value`` (ascending) repeated ``weight`` times, for
    each column of weights; not a number where all are zero."""
    upto = np.cumsum(weight, axis=0)
    total = upto[-1]
    at = q * (total - 1)
    low = np.floor(at)
    out = np.full(weight.shape[1], np.nan)
    for j in np.flatnonzero(total > 0):
        i, k = np.searchsorted(upto[:, j], [low[j], min(low[j] + 1, total[j] - 1)], "right")
        out[j] = value[i] + (at[j] - low[j]) * (value[k] - value[i])
    return out


def tail_risk(returns: DataFrame, levels: tuple = (0.95, 0.99), replicates: int = 200, least: int = 100, few: int = 30, seed: int = 0) -> DataFrame:
    """(symbol, level, n, value_at_risk, shortfall, tail, low_confidence, low, high) from rows
    (symbol, trade_date, ret): losses are positive; low and high are the 95 % interval of
    the value at risk over a Poisson bootstrap: each replicate weighs each row by its own
    Poisson draw, and quantiles are taken of the weights. Symbols with fewer than ``least``
    returns have no row; ``low_confidence``: fewer than ``few`` returns in the tail."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        r = np.sort(p["ret"].to_numpy(float)[np.isfinite(p["ret"].to_numpy(float))])
        if len(r) < least:
            return pd.DataFrame(columns=["symbol", "level", "n", "value_at_risk", "shortfall", "tail", "low_confidence", "low", "high"])
        draws = np.searchsorted(POISSON, np.random.default_rng(seed_of(seed, *key)).random((len(r), replicates)), "right")
        rows = []
        for level in levels:
            q = float(np.quantile(r, 1 - level))
            tail = r[r <= q]
            low, high = np.nanquantile(-weighted_quantiles(r, draws, 1 - level), [0.025, 0.975])
            rows.append((key[0], level, len(r), -q, -float(tail.mean()), len(tail), len(tail) < few, low, high))
        return pd.DataFrame(rows, columns=["symbol", "level", "n", "value_at_risk", "shortfall", "tail", "low_confidence", "low", "high"])

    shape = "symbol string, level double, n bigint, value_at_risk double, shortfall double, tail bigint, low_confidence boolean, low double, high double"
    return returns.where("ret IS NOT NULL").select("symbol", "ret").groupBy("symbol").applyInPandas(run, shape)


# -- block permutation --------------------------------------------------------


def permuted_closes(close: np.ndarray, block: int, n: int, seed: int) -> np.ndarray:
    """The path itself and ``n`` others: log returns after the first close dealt anew in
    blocks (the last may be shorter) and summed up again from that close. A column a path."""
    steps = np.diff(np.log(close))
    blocks = [np.arange(i, min(i + block, len(steps))) for i in range(0, len(steps), block)]
    rng = np.random.default_rng(seed)
    order = [np.concatenate([blocks[b] for b in rng.permutation(len(blocks))]) for _ in range(n)] if blocks else [np.zeros(0, int)] * n
    walk = np.column_stack([steps, *(steps[o] for o in order)])
    out = close[0] * np.exp(np.vstack([np.zeros(n + 1), np.cumsum(walk, axis=0)]))
    out[:, 0] = close
    return out


def moving_sums(x: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """The sum of the latest ``n`` rows, or of all so far, of each column. Sums of 1, 2, 4, ..
    rows are put together, so no value has to be taken out again."""
    wanted = [np.cumsum(x[: min(n, len(x))], axis=0) for n in sizes]
    out = [np.concatenate([top, np.zeros((len(x) - len(top), x.shape[1]))]) for top in wanted]
    part, size, done = x, 1, [0] * len(sizes)  # part[i]: the sum of rows i to i + size - 1
    while size <= min(max(sizes), len(x)):
        for j, n in enumerate(sizes):
            if n & size and n < len(x):
                first = 1 + done[j]  # of the frame that ends at row n
                out[j][n:] = part[first : first + len(x) - n] + (out[j][n:] if done[j] else 0)
                done[j] += size
        part, size = part[:-size] + part[size:], 2 * size
    return out


def moving_spread(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """The sample deviation of the latest n rows of each column, from ``least`` rows on."""
    out = np.full(x.shape, np.nan)
    for i in range(max(least, 2) - 1, min(n - 1, len(x))):
        out[i] = x[: i + 1].std(axis=0, ddof=1)
    if len(x) >= n:
        mean, square = moving_sums(x, n)[0][n - 1 :] / n, 0.0
        for i in range(n):
            d = x[i : len(x) - n + 1 + i] - mean
            square = square + d * d
        out[n - 1 :] = np.sqrt(square / (n - 1))
    return out


def _bit_at(mask: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each mask's set bit number k, from 0."""
    mask, k, at = mask.copy(), k.astype(np.uint8), np.zeros(mask.shape, np.uint8)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(mask & np.uint64((1 << width) - 1))
        up = k >= low
        step = up * np.uint8(width)
        k -= up * low
        at += step
        mask >>= step.astype(np.uint64)
    return at


def moving_median(x: np.ndarray, n: int, least: int, rows: int = 1024, cells: int = 1 << 20) -> np.ndarray:
    """The median of the latest n rows' values of each column, where they are ``least``. Values are
    ranked once a column; a frame's ranks are bits, and what two of its prefixes differ in.
    Some ``rows`` rows go at a time, so a longer column costs no more a row."""
    out = np.full(x.shape, np.nan)
    for top in range(0, len(x), rows):
        first = max(0, top - n + 1)
        words = -(-(min(top + rows, len(x)) - first) // 64)
        columns = max(1, cells // (words * words * 64))
        for c in range(0, x.shape[1], columns):
            out[top : top + rows, c : c + columns] = _median_of_block(x[first : top + rows, c : c + columns], n, least, words)[top - first :]
    return out


def _median_of_block(x: np.ndarray, n: int, least: int, words: int) -> np.ndarray:
    length, width = x.shape
    order = np.argsort(x, axis=0)  # not-a-number last
    row, column = np.arange(length)[:, None], np.arange(width)
    rank = np.empty((length, width), np.int64)
    rank[order, column] = row
    value = x[order, column]
    held = np.zeros((length, words, width), np.uint64)
    held[row, rank >> 6, column] = np.where(np.isnan(x), np.uint64(0), np.uint64(1) << (rank & 63).astype(np.uint64))
    for i in range(1, length):
        np.bitwise_xor(held[i], held[i - 1], out=held[i])
    if n < length:
        held[n:] ^= held[:-n].copy()
    number = np.bitwise_count(held)
    upto = np.empty((words, length, width), np.int16)
    upto[0] = number[:, 0]
    for j in range(1, words):
        np.add(upto[j - 1], number[:, j], out=upto[j])
    count = upto[-1]

    def numbered(k: np.ndarray, upto: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple:
        word, before = np.zeros(k.shape, np.uint8), np.zeros(k.shape, np.int16)
        for u in upto[:-1]:
            past = u <= k
            word += past
            np.maximum(before, u * past, out=before)
        mask = held[row, word, column]
        return word.astype(np.int64), mask, _bit_at(mask, k - before)

    k = np.maximum(count - 1, 0) >> 1
    word, mask, at = numbered(k, upto, row, column)
    out = value[np.minimum(word * 64 + at, length - 1), column]
    even = (count > 0) & (count & 1 == 0)
    if even.any():  # the next value up, in the same word or a later one
        rest = mask & ~((np.uint64(2) << at.astype(np.uint64)) - np.uint64(1))
        after = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        place = word * 64 + np.minimum(after, 63)
        t, p = np.nonzero(even & (rest == 0))
        later, _, bit = numbered(k[t, p] + 1, upto[:, t, p], t, p)
        place[t, p] = later * 64 + bit
        out = np.where(even, (out + value[np.minimum(place, length - 1), column]) / 2, out)
    return np.where(count >= max(1, least), out, np.nan)


def _smoothed(close: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Exponential means of 8 and 21 rows, and Wilder's weighted sums of rises and falls: all
    columns and all four go through one fold over the rows."""
    x = np.stack([close, close, np.maximum(change, 0), np.maximum(-change, 0)], axis=1)
    alpha = np.array([2 / 9, 2 / 22, 1.0, 1.0])[:, None]
    x[1:] *= alpha
    keep = np.broadcast_to(1 - np.array([2 / 9, 2 / 22, 1 / 14, 1 / 14])[:, None], x.shape[1:]).copy()
    held = np.empty(x.shape[1:])
    for i in range(1, len(x)):
        np.multiply(x[i - 1], keep, out=held)
        x[i] += held
    return x.transpose(1, 0, 2)


def composite_of(close: pd.DataFrame) -> pd.DataFrame:
    """rolling.composite's score of each column's path."""
    return pd.DataFrame(_composite(close.to_numpy(float)), close.index, close.columns)


def _composite(close: np.ndarray) -> np.ndarray:
    n = len(close)
    age = np.arange(1, n + 1)[:, None]

    def against(k: int, least: int, total: np.ndarray) -> np.ndarray:
        x = close * np.minimum(age, k) / total - 1
        x[: least - 1] = np.nan
        return x

    def filled(x: np.ndarray, value: float) -> np.ndarray:
        return np.where(np.isnan(x), value, x)

    with np.errstate(all="ignore"):
        change = np.zeros(close.shape)
        change[1:] = close[1:] - close[:-1]
        fast, slow, gain, loss = _smoothed(close, change)
        rsi = 100 - 100 / (1 + gain / np.where(loss != 0, loss, np.nan))
        rsi[:14] = np.nan
        ret = close[1:] / close[:-1] - 1
        usual, noise, ahead = (np.full(close.shape, np.nan) for _ in range(3))
        usual[1:] = moving_median(ret, 252, 50) * 252**0.5
        noise[1:] = moving_spread(ret, 20, 10) * 252**0.5
        ahead[63:] = close[63:] / close[:-63] - 1
        long, short = moving_sums(close, 200, 50)
        trend = 0.45 * np.clip(against(200, 50, long) / 0.15, -1, 1) + 0.35 * np.clip(against(50, 20, short) / 0.1, -1, 1) + 0.2 * np.clip((fast / slow - 1) / 0.05, -1, 1)
        momentum = 0.5 * np.clip((filled(rsi, 50.0) - 50) / 25, -1, 1) + 0.5 * filled(np.clip(ahead / 0.2, -1, 1), 0.0)
        calm = filled(np.clip(1.5 - noise / (np.where(usual != 0, usual, np.nan) + 1e-8), -1, 1), 0.0)
        return filled(np.clip(50 + 45 * (0.4 * trend + 0.35 * momentum + 0.25 * calm), 0, 100), 50.0)


def strategy_of(close: pd.DataFrame, enter: float = 65, leave: float = 45, cost_bps: float = 10) -> pd.DataFrame:
    """Each path's returns of the composite strategy, run anew on it."""
    path = close.to_numpy(float)
    score = _composite(path).round(6)
    event = (score >= enter) | (score < leave)
    at = np.maximum.accumulate(np.where(event, np.arange(len(path))[:, None], -1), axis=0)
    state = np.where(at >= 0, np.take_along_axis(score, np.maximum(at, 0), axis=0) >= enter, False).astype(float)
    held, ret = np.zeros(path.shape), np.zeros(path.shape)
    held[1:], ret[1:] = state[:-1], path[1:] / path[:-1] - 1
    moved = held.copy()
    moved[1:] -= held[:-1]
    return pd.DataFrame(held * ret - np.abs(moved) * cost_bps / 1e4, close.index, close.columns)


def permutation_test(bars: DataFrame, replicates: int = 100, block: int = 20, seed: int = 42, strategy=strategy_of) -> DataFrame:
    """(symbol, n, sharpe, null_mean, null_sd, p): the strategy's Sharpe ratio against those
    of the same rule run on block-permuted paths; p is never below 1 / (replicates + 1). A
    strategy that never holds anything has a ratio of 0. Symbols of fewer than three bars
    have no row."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        close = p.sort_values("trade_date")["close"].to_numpy(float)
        close = close[np.isfinite(close) & (close > 0)]
        if len(close) < 3:
            return pd.DataFrame(columns=["symbol", "n", "sharpe", "null_mean", "null_sd", "p"])
        x = strategy(pd.DataFrame(permuted_closes(close, block, replicates, seed_of(seed, *key)))).to_numpy()[1:]
        sd = x.std(axis=0, ddof=1)
        ratio = np.divide(x.mean(axis=0), sd, out=np.zeros_like(sd), where=sd > 1e-12) * 252**0.5
        real, null = ratio[0], ratio[1:]
        return pd.DataFrame([(key[0], len(close), real, null.mean(), null.std(), (1 + (null >= real - 1e-12).sum()) / (1 + replicates))], columns=["symbol", "n", "sharpe", "null_mean", "null_sd", "p"])

    return bars.select("symbol", "trade_date", "close").groupBy("symbol").applyInPandas(run, "symbol string, n bigint, sharpe double, null_mean double, null_sd double, p double")


# -- GARCH ---------------------------------------------------------------------


def garch_likelihood(r2: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of GARCH(1,1) and next variances, for all parameters side by side:
    one fold over the squared returns that carries every point's variance."""
    floor = r2.mean() * 1e-6
    h = np.full(len(omega), r2.mean())
    total = np.zeros(len(omega))
    for x in r2:
        total += np.log(h) + x / h
        h = np.maximum(omega + alpha * x + beta * h, floor)
    return -0.5 * (total + len(r2) * np.log(2 * np.pi)), h


def garch_fit(ret: np.ndarray, rounds: int = 6, most: float = 0.9999) -> tuple[float, ...]:
    """(omega, alpha, beta, log likelihood, next variance): a coarse grid over alpha, the
    persistence alpha + beta, and the long-run variance over the sample's; then grids of a
    third of the width around the best point."""
    r2 = ret * ret
    v = r2.mean()
    centre, width = np.array([0.15, 0.85, 0.0]), np.array([0.15, 0.1499, 1.2])
    best: tuple[float, ...] | None = None
    for step in range(rounds):
        axes = [np.linspace(c - w, c + w, k) for c, w, k in zip(centre, width, (7, 9, 5) if step == 0 else (5, 5, 5))]
        a, s, m = (g.ravel() for g in np.meshgrid(*axes, indexing="ij"))
        a, s = np.clip(a, 1e-4, 0.6), np.clip(s, 0.05, most - 1e-5)
        a = np.minimum(a, s)
        omega = v * np.exp(m) * (1 - s)
        ll, h = garch_likelihood(r2, omega, a, s - a)
        i = int(np.argmax(ll))
        if best is None or ll[i] > best[3]:
            best, centre = (omega[i], a[i], s[i] - a[i], ll[i], h[i]), np.array([a[i], s[i], m[i]])
        width = width / 3 if step else width / np.array([3, 4, 2])
    return tuple(map(float, best))


def garch(returns: DataFrame, least: int = 250) -> DataFrame:
    """(symbol, n, omega, alpha, beta, persistence, log_likelihood, next_vol) by likelihood;
    symbols with fewer than ``least`` returns, or without any variance, have no row."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        r = p.sort_values("trade_date")["ret"].to_numpy(float)
        r = r[np.isfinite(r)]
        names = ["symbol", "n", "omega", "alpha", "beta", "persistence", "log_likelihood", "next_vol"]
        if len(r) < least or not r.any():
            return pd.DataFrame(columns=names)
        omega, a, b, ll, h = garch_fit(r)
        return pd.DataFrame([(key[0], len(r), omega, a, b, a + b, ll, (252 * h) ** 0.5)], columns=names)

    shape = "symbol string, n bigint, omega double, alpha double, beta double, persistence double, log_likelihood double, next_vol double"
    return returns.where("ret IS NOT NULL").select("symbol", "trade_date", "ret").groupBy("symbol").applyInPandas(run, shape)
