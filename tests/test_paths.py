"""Moving sums, deviations and medians of matrices, and the composite's score, against plain ones."""

import numpy as np
import pandas as pd
import pytest

from panelspark import registry  # noqa: F401  plans import each other through it
from panelspark.operators import resample


@pytest.mark.parametrize("n, least", [(252, 50), (20, 10), (5, 3), (6, 1)])
def test_moving_median_is_that_of_each_frame(n, least):
    r = np.random.default_rng(n)
    x = r.normal(size=(700, 5)).round(1)  # many equal values
    x[r.random(x.shape) < 0.1] = np.nan
    want = pd.DataFrame(x).rolling(n, min_periods=least).median().to_numpy()
    for rows, cells in ((1024, 1 << 20), (64, 1 << 20), (100, 1)):
        assert np.allclose(resample.moving_median(x, n, least, rows, cells), want, rtol=0, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("n", [1, 7, 20, 64, 100, 300])
def test_moving_sums_and_deviations(n):
    x = np.random.default_rng(n).normal(size=(100, 3))
    x[40] = 1e9  # leaves nothing behind in later frames
    sums, three = resample.moving_sums(x, n, 3)
    rows = [x[max(0, i - n + 1) : i + 1] for i in range(len(x))]
    assert np.allclose(sums, [r.sum(axis=0) for r in rows], rtol=1e-12) and np.allclose(three[:2], np.cumsum(x[:2], axis=0))
    if n > 1:
        want = [r.std(axis=0, ddof=1) if len(r) >= min(n, 10) else [np.nan] * 3 for r in rows]
        assert np.allclose(resample.moving_spread(x, n, min(n, 10)), want, rtol=1e-9, equal_nan=True)


def plain_composite(close):
    ret, change = close / close.shift(1) - 1, close.diff()
    gain, loss = (x.clip(lower=0).ewm(alpha=1 / 14, adjust=True, min_periods=14).mean() for x in (change, -change))
    rsi = (100 - 100 / (1 + gain / loss.where(loss != 0))).fillna(50)
    fast, slow = (close.ewm(alpha=2 / (n + 1), adjust=False).mean() for n in (8, 21))
    mean = lambda n, least: close.rolling(n, min_periods=least).mean()
    trend = 0.45 * ((close / mean(200, 50) - 1) / 0.15).clip(-1, 1) + 0.35 * ((close / mean(50, 20) - 1) / 0.1).clip(-1, 1) + 0.2 * ((fast / slow - 1) / 0.05).clip(-1, 1)
    momentum = 0.5 * ((rsi - 50) / 25).clip(-1, 1) + 0.5 * ((close / close.shift(63) - 1) / 0.2).clip(-1, 1).fillna(0)
    usual, noise = ret.rolling(252, min_periods=50).median() * 252**0.5, ret.rolling(20, min_periods=10).std() * 252**0.5
    calm = (1.5 - noise / (usual.where(usual != 0) + 1e-8)).clip(-1, 1).fillna(0)
    return (50 + 45 * (0.4 * trend + 0.35 * momentum + 0.25 * calm)).clip(0, 100).fillna(50)


@pytest.mark.parametrize("n", [2, 15, 51, 201, 254, 533, 1300])
def test_composite_of_paths(n):
    close = 100 * np.exp(np.cumsum(np.random.default_rng(n).normal(0.001, 0.01, (n, 4)), axis=0))
    close[:, 1] = 7.0
    close[n // 3 : n // 2, 2] = close[n // 3, 2]
    close = pd.DataFrame(close)
    score = resample.composite_of(close)
    assert np.allclose(score, plain_composite(close), rtol=0, atol=1e-9)
    event = pd.DataFrame(np.where(score.round(6) >= 65, 1.0, np.where(score.round(6) < 45, 0.0, np.nan)))
    held = event.ffill().fillna(0).shift(1).fillna(0)
    want = held * (close / close.shift(1) - 1).fillna(0) - (held - held.shift(1).fillna(0)).abs() * 10 / 1e4
    assert np.allclose(resample.strategy_of(close), want, rtol=0, atol=1e-12)
