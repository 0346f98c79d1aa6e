"""Values of queries that have no SQL, from their own inputs."""

import numpy as np
import pytest

from panelspark import registry
from panelspark.plans import risk
from tests.conftest import SMALL


def test_factor_exposures(spark):
    """Coefficients and Newey-West errors of one symbol by plain linear algebra."""
    p = risk.factor_panel(spark, SMALL)
    names = risk.factor_names(p)
    assert len(names) == len(risk.sector_names(spark, SMALL)) + 3 == 8
    got = {r.symbol: r for r in registry.QUERIES["st1_factor_exposures"](spark, SMALL).collect()}
    symbol = max(got, key=lambda s: got[s].n)
    rows = p.where(f"symbol = '{symbol}'").orderBy("trade_date").select("ret", *names).collect()
    x, y = np.array([[1.0, *r[1:]] for r in rows]), np.array([r[0] for r in rows])
    inv = np.linalg.pinv(x.T @ x)
    coef = inv @ x.T @ y
    e = y - x @ coef
    z, n = x * e[:, None], len(y)
    lags = int(4 * (n / 100) ** (2 / 9))
    s = z.T @ z
    for k in range(1, lags + 1):
        g = z[k:].T @ z[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    r = got[symbol]
    assert r.n == n and r.alpha == pytest.approx(coef[0] * 252, abs=1e-4) and np.allclose(r.betas, coef[1:], atol=1e-4)
    assert np.allclose(r.errors, np.sqrt(np.diag(inv @ s @ inv))[1:], rtol=1e-3, atol=1e-4)
    assert r.r2 == pytest.approx(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())), abs=1e-5)


def test_earnings_events(spark):
    """Places in the pool from the returns themselves; eight prints a symbol at most."""
    rows = registry.QUERIES["es5_earnings_events"](spark, SMALL).collect()
    cars = [r.car for r in rows if r.car is not None]
    assert cars and max(sum(r.symbol == s for r in rows) for s in {r.symbol for r in rows}) <= 8
    for r in rows:
        want = None if r.car is None else round(100 * sum(c <= r.car for c in cars) / len(cars), 6)
        assert r.pool_pct == (pytest.approx(want, abs=2e-6) if want is not None else None)
        assert r.significant == (r.p is not None and r.p < 0.05)


def test_leak_check(spark):
    """Returns dealt anew keep nothing of the signal's correlation."""
    (r,) = registry.QUERIES["st14_leak_check"](spark, SMALL.replace("0.001", "0.01")).collect()
    assert r.dates > 100 and abs(r.shuffled_ic) < 0.03 and r.mean_ic is not None
    (none,) = registry.QUERIES["st14_leak_check"](spark, SMALL).collect()  # no date has a cross-section
    assert none.dates == 0 and none.mean_ic is None


def test_gated_ranks(spark):
    """Only validated signals show places, and these are whole."""
    rows = registry.QUERIES["r14_gated_ranks"](spark, SMALL).collect()
    for r in rows:
        assert (r.place is None) == (r.status != "validated") and (r.percentile is None or 0 <= r.percentile <= 100)
    assert {r.signal for r in rows} == {"momentum", "reversal", "low_vol", "residual_reversal"}
