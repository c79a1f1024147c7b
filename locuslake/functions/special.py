"""Special functions and a bounded minimiser that neither Spark nor NumPy has."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_ERFC = np.frompyfunc(math.erfc, 1, 1)


def logsumexp(x: np.ndarray) -> float:
    top = float(np.max(x))
    return top if not math.isfinite(top) else top + math.log(float(np.exp(x - top).sum()))


def normal_cdf(x) -> np.ndarray:
    return 0.5 * np.asarray(_ERFC(-np.asarray(x, float) / math.sqrt(2)), float)


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def log10_p_value(z) -> np.ndarray:
    """-log10 of the two-sided p value of a z score; by the asymptotic series of the tail where erfc would lose digits."""
    z = np.abs(np.asarray(z, float))
    with np.errstate(divide="ignore"):
        near = -np.log10(np.asarray(_ERFC(np.minimum(z, 35.0) / math.sqrt(2)), float))
    s = 1 / np.maximum(z, 1.0) ** 2
    tail = np.where(z < 35, 1.0, 1 - s * (1 - 3 * s * (1 - 5 * s)))
    far = (z * z / 2 + 0.5 * math.log(math.pi / 2) + np.log(np.maximum(z, 1.0)) - np.log(tail)) / math.log(10)
    return np.where(z < 35, near, far)


def digamma(x: float) -> float:
    """By recurrence to a large argument and the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def minimise(f: Callable[[float], float], low: float, high: float, tol: float = 1e-8, steps: int = 100, cells: int = 16) -> float:
    """The least place of a function, from the best cell of a coarse grid, so that one local minimum doesn't hide a deeper one.

    In the cell, parabolas through the three best places so far propose the next one; where a
    proposal leaves the bracket or moves more than half of the move before last, a golden
    section is taken instead.
    """
    grid = [low + (high - low) * k / cells for k in range(cells + 1)]
    values = [f(x) for x in grid]
    k = int(np.argmin(values))
    a, b = grid[max(0, k - 1)], grid[min(cells, k + 1)]
    golden = (3 - math.sqrt(5)) / 2
    if 0 < k < cells:
        best = [(values[k], grid[k])] + sorted([(values[k - 1], a), (values[k + 1], b)])
    else:  # the edge itself may be least: begin inside the cell beside it
        x = a + golden * (b - a)
        best = sorted([(f(x), x), (values[k], grid[k])]) * 2
    edge = (values[k], grid[k])
    x = best[0][1]
    if not a < x < b:
        x = a + golden * (b - a)
        best = [(f(x), x)] * 3
    move = earlier = b - a
    for _ in range(steps):
        (fx, x), (fw, w), (fv, v) = best[:3]
        close = tol * (1 + abs(x))
        if b - a < 2 * close or max(x - a, b - x) < 2 * close:
            break
        p, q = 0.0, 0.0
        if x != w != v != x:
            r, s = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * s - (x - w) * r, 2 * (r - s)
        step = p / q if q else math.inf
        if abs(step) < abs(earlier) / 2 and a + close < x + step < b - close:
            earlier, move = move, step
        else:
            earlier = (b - x) if x < (a + b) / 2 else (a - x)
            move = golden * earlier
        u = x + (move if abs(move) >= close else math.copysign(close, move))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u > x else (a, x)
        else:
            a, b = (a, u) if u > x else (u, b)
        best = sorted([(fu, u), *best[:3]], key=lambda t: t[0])[:3]
    return best[0][1] if best[0][0] <= edge[0] else edge[1]


def minimise_many(f: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, low: float, high: float, tol: float = 1e-8, steps: int = 100, cells: int = 16) -> np.ndarray:
    """``minimise`` of ``size`` functions at once; ``f(x, at)`` gives those numbered ``at``, each at its own x."""
    every = np.arange(size)
    grid = np.array([low + (high - low) * k / cells for k in range(cells + 1)])
    values = np.stack([f(np.full(size, x), every) for x in grid], 1)
    k = values.argmin(1)
    left, right = np.maximum(k - 1, 0), np.minimum(k + 1, cells)
    a, b = grid[left], grid[right]
    golden = (3 - math.sqrt(5)) / 2
    least, edge = values[every, k], grid[k]
    y = np.stack([least, values[every, left], values[every, right]], 1)  # the three best values, and their places
    x = np.stack([edge, a, b], 1)
    swap = (y[:, 2] < y[:, 1])[:, None] & [False, True, True]
    y, x = np.where(swap, y[:, [0, 2, 1]], y), np.where(swap, x[:, [0, 2, 1]], x)
    if len(outer := np.flatnonzero((k == 0) | (k == cells))):  # the edge itself may be least: begin inside the cell beside it
        inner = a[outer] + golden * (b - a)[outer]
        y[outer], x[outer] = f(inner, outer)[:, None], inner[:, None]
    found_y, found_x = y[:, 0].copy(), x[:, 0].copy()
    at, move, earlier = every, b - a, b - a
    for _ in range(steps):
        close = tol * (1 + np.abs(x[:, 0]))
        over = (b - a < 2 * close) | (np.maximum(x[:, 0] - a, b - x[:, 0]) < 2 * close)
        if over.any():
            found_y[at[over]], found_x[at[over]] = y[over, 0], x[over, 0]
            at, a, b, x, y, move, earlier, close = (v[~over] for v in (at, a, b, x, y, move, earlier, close))
        if not len(at):
            break
        (x0, w, v), (fx, fw, fv) = x.T, y.T
        r, s = (x0 - w) * (fx - fv), (x0 - v) * (fx - fw)
        p, q = (x0 - v) * s - (x0 - w) * r, 2 * (r - s)
        known = (x0 != w) & (w != v) & (v != x0) & (q != 0)
        step = np.divide(p, q, out=np.full(len(at), np.inf), where=known)
        take = (np.abs(step) < np.abs(earlier) / 2) & (a + close < x0 + step) & (x0 + step < b - close)
        section = np.where(x0 < (a + b) / 2, b - x0, a - x0)
        earlier, move = np.where(take, move, section), np.where(take, step, golden * section)
        u = x0 + np.where(np.abs(move) >= close, move, np.copysign(close, move))
        fu = f(u, at)
        up, better = u > x0, fu <= fx
        a, b = np.where(better & up, x0, np.where(~better & ~up, u, a)), np.where(better & ~up, x0, np.where(~better & up, u, b))
        y, x = np.column_stack([fu, y]), np.column_stack([u, x])
        order = np.argsort(y, 1, kind="stable")[:, :3]
        y, x = np.take_along_axis(y, order, 1), np.take_along_axis(x, order, 1)
    found_y[at], found_x[at] = y[:, 0], x[:, 0]
    return np.where(found_y <= least, found_x, edge)
