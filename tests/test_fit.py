import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prodlake.functions import fit


def rate(t, qi, di, b):
    if b == 0:
        return qi * np.exp(-di * t)
    return qi / (1 + b * di * t) ** (1 / b)


@settings(max_examples=40, deadline=None)
@given(
    qi=st.floats(1, 1e6), di=st.floats(0.01, 0.5), b=st.floats(0.05, 0.95),
    months=st.integers(24, 120), kind=st.sampled_from(fit.MODELS),
)
def test_exact_curves_are_recovered(qi, di, b, months, kind):
    b = {"exponential": 0.0, "hyperbolic": b, "harmonic": 1.0}[kind]
    q = rate(np.arange(months), qi, di, b)
    q = q[q > 10 * fit.RATE_FLOOR]
    if len(q) < 12:
        return
    got = fit.fit_batch([q]).iloc[0]
    assert got.r2 >= 1 - 1e-9
    future = np.arange(months, months + 24)
    assert rate(future, got.qi, got.di, got.b) == pytest.approx(rate(future, qi, di, b), rel=1e-4)


def brute_force_error(q):
    """Smallest squared error over a fine grid of all three models."""
    t = np.arange(len(q))
    di = np.exp(np.linspace(np.log(fit.DI_BOUNDS[0]), np.log(fit.DI_BOUNDS[1]), 1500))[:, None]
    best = np.inf
    for b in [0.0, 1.0, *np.linspace(*fit.B_BOUNDS, 80)]:
        f = rate(t, 1.0, di, b)
        qi = np.clip((f @ q) / (f * f).sum(1), 0, fit.QI_FACTOR * q[0])
        best = min(best, ((q - qi[:, None] * f) ** 2).sum(1).min())
    return best


def test_noisy_series_are_at_least_as_good_as_brute_force():
    draw = np.random.default_rng(7)
    series = []
    for _ in range(12):
        t = np.arange(draw.integers(6, 90))
        q = rate(t, draw.uniform(50, 900), draw.uniform(0.01, 0.3), draw.uniform(0.1, 0.9))
        series.append(np.maximum(q * draw.normal(1, 0.1, len(t)), 0))
        series.append(draw.uniform(10, 500, len(t)))  # no decline at all
    fits = fit.fit_batch(series)
    for q, got in zip(series, fits.itertuples()):
        q = np.maximum(q, fit.RATE_FLOOR)
        error = ((q - rate(np.arange(len(q)), got.qi, got.di, got.b)) ** 2).sum()
        assert error <= brute_force_error(q) * (1 + 1e-9)
        assert 0 <= got.qi <= fit.QI_FACTOR * q[0] * (1 + 1e-12)
        assert fit.DI_BOUNDS[0] * (1 - 1e-9) <= got.di <= fit.DI_BOUNDS[1] * (1 + 1e-9)


def test_special_series():
    fits = fit.fit_batch(
        [
            np.full(12, 7.0), np.zeros(8), np.array([4.0, 2, np.nan, 3, 4, 5]),
            np.array([0.0, 5, 4, 3, 2, 1]),
        ]
    )
    constant, zero, broken, from_zero = fits.itertuples()
    assert (constant.model, constant.r2) == ("exponential", 0.0)
    assert (zero.model, zero.qi, zero.di, zero.b, zero.r2) == ("flat", 0.0, 0.0, 0.0, 0.0)
    assert (broken.model, broken.qi, broken.di) == ("flat", 4.0, 0.0)
    assert from_zero.qi <= fit.QI_FACTOR * fit.RATE_FLOOR * (1 + 1e-12)


def test_a_series_does_not_depend_on_its_batch():
    draw = np.random.default_rng(3)
    series = [draw.uniform(1, 9, n) for n in (6, 80, 17, 33)]
    together = fit.fit_batch(series)
    for i, q in enumerate(series):
        alone = fit.fit_batch([q]).iloc[0]
        assert alone.model == together.model[i]
        assert alone[["qi", "di", "b", "r2"]].tolist() == pytest.approx(
            together.loc[i, ["qi", "di", "b", "r2"]].tolist(), rel=1e-6
        )


def test_many_chunks_keep_the_order():
    q = [rate(np.arange(30), 100.0 + i, 0.05, 0.0) for i in range(2 * fit._CHUNK + 3)]
    got = fit.fit_batch([*q, np.zeros(3)])
    assert got.qi[:-1].tolist() == pytest.approx([100.0 + i for i in range(len(q))])
    assert got.model.iloc[-1] == "flat"
