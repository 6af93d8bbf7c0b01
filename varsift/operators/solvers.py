"""Two solvers in NumPy: a quasi-Newton minimiser and a convex least-squares problem with lower bounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """BFGS with a backtracking line search; objective gives value and gradient."""
    x = np.array(start, float)
    value, slope = objective(x)
    inverse = np.eye(len(x))
    for _ in range(steps):
        direction = -inverse @ slope
        along = float(slope @ direction)
        if along >= 0:
            inverse, direction = np.eye(len(x)), -slope
            along = float(slope @ direction)
        if along == 0:
            break
        size = 1.0
        while size > 1e-14:
            tried = x + size * direction
            new_value, new_slope = objective(tried)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * size * along:
                break
            size /= 2
        else:
            break
        moved, turned = tried - x, new_slope - slope
        gain = value - new_value
        x, value, slope = tried, new_value, new_slope
        curve = float(moved @ turned)
        if curve > 1e-14:
            left = np.eye(len(x)) - np.outer(moved, turned) / curve
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / curve
        if gain <= tolerance * max(1.0, abs(value)) and np.abs(slope).max() < 1e-6 * max(1.0, abs(value)):
            break
    return x


def bounded_least_squares(gram: np.ndarray, target: np.ndarray, lower: np.ndarray, sweeps: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """argmin of p'Gp/2 - t'p with p >= lower: coordinate descent, polished on the free set."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g, t, low = gram / np.outer(scale, scale), target / scale, lower * scale
    p = low.copy()
    for _ in range(sweeps):
        biggest = 0.0
        for i in range(len(p)):
            new = max(low[i], p[i] + (t[i] - g[i] @ p) / g[i, i])
            biggest = max(biggest, abs(new - p[i]) / max(1.0, abs(new)))
            p[i] = new
        if biggest < tolerance:
            break
    free = p > low
    if free.any():
        rest = t[free] - g[np.ix_(free, ~free)] @ p[~free]
        exact, *_ = np.linalg.lstsq(g[np.ix_(free, free)], rest, rcond=None)
        if (exact >= low[free]).all():
            p[free] = exact
    return p / scale
