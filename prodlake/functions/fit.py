"""Bounded least-squares decline fits, free and on a fixed grid: all that runs in Python workers.

Spark groups, orders and distributes the series; a worker receives Arrow batches with
one array per row.  All series of a batch are fitted together with numpy:

* for a fixed curve shape the best ``qi`` has a closed form, so only ``ln di`` (and ``b``)
  are searched;
* all series share the time axis 0, 1, 2, ..., so the coarse grid over shapes is one matrix
  product; months that a series lacks on this axis have weight 0;
* the best grid cells are polished by damped Gauss-Newton steps inside the bounds.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

# Bounds of the fit, floor of the rates, order that decides ties.
DI_BOUNDS = (1e-6, 5.0)
B_BOUNDS = (0.001, 0.999)
QI_FACTOR = 10.0
RATE_FLOOR = 1e-3
MODELS = ("exponential", "hyperbolic", "harmonic")

# Search settings.
_LOG_DI = np.linspace(np.log(DI_BOUNDS[0]), np.log(DI_BOUNDS[1]), 97)
_B_GRID = np.concatenate([[B_BOUNDS[0], 0.05], np.arange(0.1, 0.95, 0.1), [0.95, B_BOUNDS[1]]])
_CHUNK = 256
_CELLS = _CHUNK * 1024  # of the matrix of a chunk; long time axes take fewer series at once
_FIRST_STEPS, _LAST_STEPS = 20, 60
_STALLED = 5  # steps without progress after which a series counts as settled
_ROUNDS = 5  # of _LAST_STEPS; a series that moves even then is reported as not converged

FIT_TYPE = StructType(
    [StructField("model", StringType())]
    + [StructField(name, DoubleType()) for name in ("qi", "di", "b", "r2")]
    + [StructField("converged", BooleanType())]
)

CELL_TYPE = StructType([StructField(name, DoubleType()) for name in ("b", "di", "qi", "r2")])

# Ship this module by value, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _shape(t, log_di, b):
    """Curve for ``qi = 1`` and the base ``1 + b di t``; ``b = 0`` is the exponential."""
    decline = np.exp(log_di)[:, None] * t
    if not b.any():  # one call never mixes the exponential with the other models
        return np.exp(-decline), np.ones_like(decline)
    growth = b[:, None] * decline
    return np.exp(-np.log1p(growth) / b[:, None]), 1.0 + growth


def _best_qi(q, f, qi_max):
    return np.clip((q * f).sum(1) / np.maximum((f * f).sum(1), 1e-300), 0.0, qi_max)


def _polish(q, w, t, qi_max, log_di, b, low, high, free_b, steps):
    """Damped Gauss-Newton on (ln di, b) with ``qi`` eliminated; a step must lower the error.

    Returns ``[qi, log_di, b, sse]`` as rows of one array, and which series have settled.
    """
    f, base = _shape(t, log_di, b)
    f = f * w
    qi = _best_qi(q, f, qi_max)
    sse = ((q - qi[:, None] * f) ** 2).sum(1)
    damping = np.full(len(q), 1e-3)
    stalled = np.zeros(len(q), dtype=int)
    for _ in range(steps):
        decline = np.exp(log_di)[:, None] * t
        model = qi[:, None] * f
        residual = q - model
        inside = ((qi > 0) & (qi < qi_max))[:, None]
        f_norm = np.maximum((f * f).sum(1), 1e-300)[:, None]

        def reduced(column):
            return column - np.where(inside, f * (f * column).sum(1)[:, None] / f_norm, 0.0)

        j_di = reduced(-model * decline / base)
        g_di = (j_di * residual).sum(1)
        a_di = (j_di * j_di).sum(1) * (1 + damping) + 1e-300
        stuck = ((log_di <= low) & (g_di < 0)) | ((log_di >= high) & (g_di > 0))
        g_di, cross = np.where(stuck, 0.0, g_di), np.zeros(len(q))
        if free_b:
            bb = b[:, None]
            j_b = reduced(model * (np.log1p(base - 1.0) / bb**2 - decline / (bb * base)))
            g_b = (j_b * residual).sum(1)
            a_b = (j_b * j_b).sum(1) * (1 + damping) + 1e-300
            b_stuck = ((b <= B_BOUNDS[0]) & (g_b < 0)) | ((b >= B_BOUNDS[1]) & (g_b > 0))
            g_b = np.where(b_stuck, 0.0, g_b)
            cross = np.where(stuck | b_stuck, 0.0, (j_di * j_b).sum(1))
            determinant = np.maximum(a_di * a_b - cross * cross, 1e-300)
            d_b = (a_di * g_b - cross * g_di) / determinant
            d_di = (a_b * g_di - cross * g_b) / determinant
            new_b = np.clip(b + np.clip(d_b, -0.5, 0.5), *B_BOUNDS)
        else:
            d_di, new_b = g_di / a_di, b
        new_log_di = np.clip(log_di + np.clip(d_di, -2.0, 2.0), low, high)

        new_f, new_base = _shape(t, new_log_di, new_b)
        new_f = new_f * w
        new_qi = _best_qi(q, new_f, qi_max)
        new_sse = ((q - new_qi[:, None] * new_f) ** 2).sum(1)
        better = new_sse < sse
        progress = better & (sse - new_sse > 1e-14 * sse)
        stalled = np.where(progress, 0, stalled + 1)
        keep = better[:, None]
        log_di, b = np.where(better, new_log_di, log_di), np.where(better, new_b, b)
        qi, sse = np.where(better, new_qi, qi), np.where(better, new_sse, sse)
        f, base = np.where(keep, new_f, f), np.where(keep, new_base, base)
        damping = np.clip(np.where(better, damping * 0.2, damping * 6.0), 1e-12, 1e10)
        if (stalled >= _STALLED).all():
            break
    return np.array([qi, log_di, b, sse]), stalled >= _STALLED


def _finish(q, w, t, qi_max, log_di, b, low, high, free_b):
    """Polish all series, then go on with those that need more steps.

    Rows: ``qi, log_di, b, sse`` and 1 where the series has settled.
    """
    found, settled = _polish(q, w, t, qi_max, log_di, b, low, high, free_b, _FIRST_STEPS)
    for _ in range(_ROUNDS):
        more = np.flatnonzero(~settled)
        if not len(more):
            break
        found[:, more], settled[more] = _polish(
            q[more], w[more], t, qi_max[more], found[1, more], found[2, more],
            low[more], high[more], free_b, _LAST_STEPS,
        )
    return np.vstack([found, settled])


def _grid(q, w, t, qi_max, b_values):
    """Squared error of every (series, b, ln di) cell with the best ``qi`` for each."""
    log_di = np.tile(_LOG_DI, len(b_values))
    f, _ = _shape(t, log_di, np.repeat(b_values, len(_LOG_DI)))
    num, den = q @ f.T, np.maximum(w @ (f * f).T, 1e-300)
    qi = np.clip(num / den, 0.0, qi_max[:, None])
    sse = (q * q).sum(1)[:, None] - 2 * qi * num + qi * qi * den
    return sse.reshape(len(q), len(b_values), len(_LOG_DI))


def _fit_fixed_b(q, w, t, qi_max, b_value):
    cell = _grid(q, w, t, qi_max, np.array([b_value]))[:, 0].argmin(1)
    low = _LOG_DI[np.maximum(cell - 1, 0)]
    high = _LOG_DI[np.minimum(cell + 1, len(_LOG_DI) - 1)]
    b = np.full(len(q), b_value)
    return _finish(q, w, t, qi_max, _LOG_DI[cell], b, low, high, False)[[0, 1, 2, 4]]


def _fit_free_b(q, w, t, qi_max):
    """Start once on every grid value of ``b``, then finish the three best of them."""
    starts = len(_B_GRID)
    cell = _grid(q, w, t, qi_max, _B_GRID).argmin(2)
    rows = np.repeat(np.arange(len(q)), starts)
    low, high = np.full(len(rows), _LOG_DI[0]), np.full(len(rows), _LOG_DI[-1])
    begun, _ = _polish(
        q[rows], w[rows], t, qi_max[rows], _LOG_DI[cell].ravel(), np.tile(_B_GRID, len(q)),
        low, high, True, 8,
    )
    best = np.argsort(begun[3].reshape(len(q), starts), axis=1, kind="stable")[:, :3]
    picked = (best + np.arange(len(q))[:, None] * starts).ravel()
    rows = rows[picked]
    found = _finish(
        q[rows], w[rows], t, qi_max[rows], begun[1, picked], begun[2, picked],
        low[picked], high[picked], True,
    )
    top = found[3].reshape(len(q), 3).argmin(1) + np.arange(len(q)) * 3
    return found[[0, 1, 2, 4]][:, top]


def _on_axis(series, places):
    """The series on one time axis of months: the axis, values and weights; lacking months have weight 0."""
    width = max(int(p[-1]) + 1 for p in places)
    t = np.arange(width, dtype=float)
    q, w = np.zeros((len(series), width)), np.zeros((len(series), width))
    for i, (s, p) in enumerate(zip(series, places, strict=True)):
        q[i, p], w[i, p] = s, 1.0
    return t, q, w


def _in_chunks(rows: list[int], times: list[np.ndarray]):
    """``rows`` in pieces whose matrix of series and months stays bounded."""
    while rows:
        piece = rows[:_CHUNK]
        width = max(int(times[i][-1]) + 1 for i in piece)
        piece = piece[: max(1, _CELLS // width)]
        yield piece
        rows = rows[len(piece) :]


def _r_squared(q, w, predicted):
    mean = q.sum(1) / w.sum(1)
    residual = (((q - predicted) * w) ** 2).sum(1)
    total = (((q - mean[:, None]) * w) ** 2).sum(1)
    return np.where(total > 0, 1 - residual / np.where(total > 0, total, 1.0), 0.0)


def _fit_chunk(series: list[np.ndarray], places: list[np.ndarray]) -> pd.DataFrame:
    """``places`` are the times of the values, the first one 0."""
    t, q, w = _on_axis([np.maximum(s, RATE_FLOOR) for s in series], places)
    qi_max = q[:, 0] * QI_FACTOR
    fits = {
        "exponential": _fit_fixed_b(q, w, t, qi_max, 0.0),
        "hyperbolic": _fit_free_b(q, w, t, qi_max),
        "harmonic": _fit_fixed_b(q, w, t, qi_max, 1.0),
    }
    scores = np.array(
        [
            _r_squared(q, w, qi[:, None] * _shape(t, log_di, b)[0] * w)
            for qi, log_di, b, _ in (fits[m] for m in MODELS)
        ]
    )
    winner = scores.argmax(0)  # the first model wins ties
    row = np.arange(len(series))
    qi, log_di, b, settled = (np.array([fits[m][k] for m in MODELS])[winner, row] for k in range(4))
    return pd.DataFrame(
        {
            "model": np.array(MODELS, dtype=object)[winner],
            "qi": qi,
            "di": np.exp(log_di),
            "b": b,
            "r2": scores[winner, row],
            "converged": settled > 0,
        }
    )


def fit_batch(series: list[np.ndarray], places: list[np.ndarray] | None = None) -> pd.DataFrame:
    """One fitted model per series; series that cannot be fitted become flat.

    ``places`` are the times of each series' values, ascending whole numbers from 0; by default
    0, 1, 2, ...
    """
    arrays = [np.asarray(s, dtype=float) for s in series]
    times = [np.arange(len(s)) for s in arrays] if places is None else [np.asarray(p, dtype=int) for p in places]
    out = pd.DataFrame(
        {
            "model": "flat",
            "qi": [
                float(max(s[0], RATE_FLOOR)) if len(s) and np.nanmax(s) > 0 else 0.0
                for s in arrays
            ],
            "di": 0.0, "b": 0.0, "r2": 0.0, "converged": True,
        }
    )
    usable = [i for i, s in enumerate(arrays) if len(s) and np.isfinite(s).all() and s.max() > 0]
    for rows in _in_chunks(usable, times):
        out.iloc[rows] = _fit_chunk([arrays[i] for i in rows], [times[i] for i in rows]).values
    return out.astype({"qi": float, "di": float, "b": float, "r2": float, "converged": bool})


@F.pandas_udf(FIT_TYPE)
def fit_decline(series: pd.Series) -> pd.DataFrame:
    return fit_batch(list(series))


@F.pandas_udf(FIT_TYPE)
def fit_decline_at(places: pd.Series, series: pd.Series) -> pd.DataFrame:
    return fit_batch(list(series), list(places))


def _cell_curve(t, di, b):
    if b == 0:
        return np.exp(-di * t)
    if b == 1:
        return 1.0 / (1.0 + di * t)
    return 1.0 / np.power(1.0 + b * di * t, 1.0 / b)


def _best_cells(t, q, w, cells: list[tuple[float, float]]) -> np.ndarray:
    """Rows ``b, di, qi, r2`` of the cell with the smallest squared error, NaN counting as the largest."""
    limit = q[:, 0] * QI_FACTOR
    best, least = np.empty((3, len(q))), np.empty(len(q))
    for place, (b, di) in enumerate(cells):
        f = _cell_curve(t, di, b)
        qi = np.fmin((q * f).sum(1) / (w * (f * f)).sum(1), limit)
        sse = (((q - qi[:, None] * f) * w) ** 2).sum(1)
        better = (sse < least) | (np.isnan(least) & ~np.isnan(sse)) if place else np.ones(len(q), bool)
        best[:, better] = np.array([np.full(len(q), b), np.full(len(q), di), qi])[:, better]
        least = np.where(better, sse, least)
    spread = (((q - (q.sum(1) / w.sum(1))[:, None]) * w) ** 2).sum(1)
    return np.vstack([best, np.where(spread <= 0, 0.0, 1 - least / np.where(spread <= 0, 1.0, spread))])


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    return [np.empty(0) if x.values is None else x.values.to_numpy(zero_copy_only=False) for x in lists]


def grid_batch(series: list[np.ndarray], places: list[np.ndarray], di_grid: list[float], b_grid: list[float]) -> np.ndarray:
    """Rows ``b, di, qi, r2`` of the best cell per series of floored rates; the smallest (b, di) wins ties.

    One cell at a time is laid over all series of a chunk, so memory does not grow with the grid.
    """
    cells = sorted((b, di) for b in set(b_grid) for di in set(di_grid))
    out = np.full((4, len(series)), np.nan)
    with np.errstate(invalid="ignore", over="ignore"):  # rates that are no numbers give NaN, as in SQL
        for rows in _in_chunks([i for i, s in enumerate(series) if len(s)], places):
            out[:, rows] = _best_cells(*_on_axis([series[i] for i in rows], [places[i] for i in rows]), cells)
    return out


def fit_grid(di_grid: list[float], b_grid: list[float]):
    """A function of (rates) or (places, rates) columns that gives the best cell as a struct."""

    def cells(series: list[np.ndarray], places: list[np.ndarray]) -> pa.StructArray:
        found = grid_batch(series, places, di_grid, b_grid)
        return pa.StructArray.from_arrays([pa.array(x) for x in found], CELL_TYPE.names)  # NaN stays NaN

    @F.arrow_udf(CELL_TYPE)
    def in_order(rates: pa.Array) -> pa.Array:
        series = _arrays(rates)
        return cells(series, [np.arange(len(s)) for s in series])

    @F.arrow_udf(CELL_TYPE)
    def at_places(places: pa.Array, rates: pa.Array) -> pa.Array:
        return cells(_arrays(rates), _arrays(places))

    return lambda *columns: (in_order if len(columns) == 1 else at_places)(*columns)
