"""Solvers and models against known parameters."""

from __future__ import annotations

import numpy as np
import pytest

from varsift.operators import error_model, solvers


def test_minimise():
    x = solvers.minimise(lambda p: (float(((p - [1, -2]) ** 2).sum()), 2 * (p - [1, -2])), np.zeros(2))
    assert x == pytest.approx([1, -2], abs=1e-6)


@pytest.mark.parametrize("lower", [np.zeros(4), np.array([1.5, -5, 0.9, 0])])
def test_bounded_least_squares(lower):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 4)) * [1, 10, 0.01, 3]
    gram, target = a.T @ a, a.T @ (a @ [1, -2, 3, 0.5])
    p = solvers.bounded_least_squares(gram, target, lower)
    slope = gram @ p - target
    scale = np.diag(gram)
    assert (p >= lower - 1e-12).all()
    assert all(abs(s) < 1e-6 * d if x > low + 1e-9 else s > -1e-6 * d for s, x, low, d in zip(slope, p, lower, scale))


def test_deviation_gradient():
    rng = np.random.default_rng(3)
    fits, p = rng.normal(size=(50, 3)), np.array([1, 1.2, 0.8, 0.1, 0, -0.2])
    _, slope = error_model.deviation(p, fits)
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        assert slope[i] == pytest.approx((error_model.deviation(p + step, fits)[0] - error_model.deviation(p - step, fits)[0]) / 2e-6, rel=1e-4, abs=1e-4)


def normalisable(spark, n=500):
    rng = np.random.default_rng(5)
    truth = rng.normal(size=n)
    scales, shifts = [1, 1.2, 0.9], [0, -0.1, 0.05]
    rows = [tuple(float(truth[i] / s - d + rng.normal() * 0.05) for s, d in zip(scales, shifts)) for i in range(n)]
    return spark.createDataFrame(rows, "fitness1 double, fitness2 double, fitness3 double")


def test_normalisation(spark, monkeypatch):
    df = normalisable(spark)
    model = error_model.fit_normalisation(df, [1, 2, 3])
    assert model.scale[1] == 1 and model.scale[2] / model.scale[3] == pytest.approx(1.2 / 0.9, abs=0.1)
    fits = np.array([tuple(r) for r in df.collect()])
    p = np.array([1, 1.1, 0.9, 0.1, 0, 0])
    value, slope = error_model._distributed_deviation(df, ["fitness1", "fitness2", "fitness3"])(p)
    want = error_model.deviation(p, fits)
    assert value == pytest.approx(want[0]) and slope == pytest.approx(want[1])


def test_normal_equations_recover_parameters():
    rng = np.random.default_rng(6)
    n, k = 60_000, 2
    cin, cout = 1 / rng.uniform(20, 200, (n, k)), 1 / rng.uniform(20, 200, (n, k))
    truth = np.array([2.0, 3.0, 1.5, 2.5, 0.01, 0.02])
    var = truth[:2] * cin + truth[2:4] * cout + truth[4:]
    fits = rng.normal(size=(n, k)) * np.sqrt(var)
    weight = 1 / var.mean(1) ** 2
    gram, target = error_model.normal_equations(fits, cin, cout, weight)
    p = solvers.bounded_least_squares(gram, target, np.r_[np.ones(4), np.full(2, 1e-4)])
    predicted = lambda q: (q[:2] * cin + q[2:4] * cout + q[4:]).mean(1)
    assert predicted(p).mean() == pytest.approx(predicted(truth).mean(), rel=0.03)
    assert (p >= np.r_[np.ones(4), np.full(2, 1e-4)]).all()


def test_subsets():
    assert error_model.subsets(3) == [(0, 1, 2), (0, 1), (0, 2), (1, 2)]


def test_summary():
    rows = error_model.summarise(np.array([[1.0, 2, 3], [3.0, 4, 5], [np.nan] * 3]), [7])
    assert rows[0] == {"parameter": "input", "rep": 7, "mean_value": 2.0, "CI90_lower": pytest.approx(1.2), "CI90_upper": pytest.approx(2.8), "ensemble": 2}


# --- the fits against independent solvers -----------------------------------------------------------------------------


def simplex(value, start, steps=4000):
    """Nelder and Mead's search, which uses no gradient."""
    points = [np.array(start, float)] + [np.array(start, float) + 0.1 * e for e in np.eye(len(start))]
    for _ in range(steps):
        points.sort(key=value)
        if abs(value(points[0]) - value(points[-1])) < 1e-12 * abs(value(points[0])):
            break
        middle = np.mean(points[:-1], 0)
        mirrored = 2 * middle - points[-1]
        if value(mirrored) < value(points[0]):
            points[-1] = min((3 * middle - 2 * points[-1], mirrored), key=value)
        elif value(mirrored) < value(points[-2]):
            points[-1] = mirrored
        else:
            inner = (middle + points[-1]) / 2
            points = [*points[:-1], inner] if value(inner) < value(points[-1]) else [points[0], *((points[0] + p) / 2 for p in points[1:])]
    return min(points, key=value)


def test_normalisation_against_another_search(spark):
    df = normalisable(spark, 120)
    fits = np.array([tuple(r) for r in df.collect()])

    def value(p):
        moved = fits + p[3:]
        return float(np.sqrt(((moved * p[:3] - moved.mean(1, keepdims=True)) ** 2).sum(1)).sum())

    model = error_model.fit_normalisation(df, [1, 2, 3])
    other = simplex(value, simplex(value, simplex(value, [1, 1, 1, 0, 0, 0])))
    found = solvers.minimise(lambda p: error_model.deviation(p, fits), np.r_[np.ones(3), np.zeros(3)])
    assert value(found) <= value(other) * (1 + 1e-4)
    assert [model.scale[e] for e in (1, 2, 3)] == pytest.approx((found[:3] / found[0]).tolist(), abs=1e-3)


def counted(spark, n=400):
    rng = np.random.default_rng(11)
    rows = [("a" * 30, 0, True, 5000, 9000, 4000, 8500)]
    for i in range(n):
        a, b = rng.integers(30, 400, 2)
        effect = np.exp(rng.normal(0, 0.3))
        rows.append((f"{i:030d}", int(1 + i % 2), False, int(a), int(rng.poisson(a * 1.8 * effect) + 1), int(b), int(rng.poisson(b * 2.1 * effect) + 1)))
    return spark.createDataFrame(rows, "nt_seq string, Nham_nt int, WT boolean, count_e1_s0 bigint, count_e1_s1 bigint, count_e2_s0 bigint, count_e2_s1 bigint")


def bounded_by_trial(gram, target, lower):
    """The least of p'Gp/2 - t'p over all choices of parameters that stand at their bounds."""
    best = None
    for mask in range(1 << len(lower)):
        free = np.array([bool(mask >> i & 1) for i in range(len(lower))])
        p = lower.copy()
        if free.any():
            p[free] = np.linalg.lstsq(gram[np.ix_(free, free)], target[free] - gram[np.ix_(free, ~free)] @ lower[~free], rcond=None)[0]
        if (p >= lower - 1e-9).all() and (best is None or p @ gram @ p / 2 - target @ p < best[0]):
            best = (p @ gram @ p / 2 - target @ p, p)
    return best[1]


def test_bootstraps_against_plain_rows(spark, monkeypatch):
    """Mean parameters of the fit equal those of every resample worked out row by row and solved by trial."""
    table = counted(spark)
    errors, _ = error_model.fit(table, [1, 2], False, True, n_bootstraps=5, max_n=150, seed=3)
    rows = [r for r in sorted(table.collect(), key=lambda r: r.nt_seq)]
    wt = next(r for r in rows if r.WT)
    ratios = sorted(np.log(r[f"count_e{e}_s1"] / r[f"count_e{e}_s0"]) for r in rows for e in (1, 2))
    least = np.exp(-np.percentile(ratios, 1))
    kept = [r for r in rows if not r.WT and all(r[f"count_e{e}_s0"] > least for e in (1, 2))]
    sizes = {d: sum(r.Nham_nt == d for r in rows) for d in (0, 1, 2)}
    found = []
    for s in np.random.default_rng(3).integers(0, 2**31, size=5).tolist():
        gram, target = np.zeros((6, 6)), np.zeros(6)
        for i in np.random.default_rng(s).choice(len(kept), size=150, replace=True):
            r = kept[i]
            f = [np.log(r[f"count_e{e}_s1"] / r[f"count_e{e}_s0"]) - np.log(wt[f"count_e{e}_s1"] / wt[f"count_e{e}_s0"]) for e in (1, 2)]
            errs = [np.sqrt(1 / r[f"count_e{e}_s0"] + 1 / r[f"count_e{e}_s1"] + 1 / wt[f"count_e{e}_s0"] + 1 / wt[f"count_e{e}_s1"]) for e in (1, 2)]
            n = sizes[r.Nham_nt]
            share = np.sqrt(n) if n > np.sqrt(len(rows)) else len(rows) ** 0.25
            weight = 1 / (np.mean(errs) ** 2 * share)
            x = np.array([1 / r.count_e1_s0, 1 / r.count_e2_s0, 1 / r.count_e1_s1, 1 / r.count_e2_s1, 1, 1]) / 2
            gram += weight * np.outer(x, x)
            target += weight * x * np.var(f, ddof=1)
        found.append(bounded_by_trial(gram, target, np.r_[np.ones(4), np.full(2, 1e-4)]))
    assert [r["mean_value"] for r in errors.rows] == pytest.approx(np.mean(found, 0).tolist(), rel=1e-6)
    assert [r["CI90_lower"] for r in errors.rows] == pytest.approx(np.percentile(found, 10, axis=0).tolist(), rel=1e-6)
    # a table too large for a broadcast copy gives the same resamples
    monkeypatch.setattr(error_model, "POOL_ROWS", 10)
    again, _ = error_model.fit(table, [1, 2], False, True, n_bootstraps=5, max_n=150, seed=3)
    for a, b in zip(errors.rows, again.rows):
        assert [a[k] for k in ("mean_value", "CI90_lower", "CI90_upper")] == pytest.approx([b[k] for k in ("mean_value", "CI90_lower", "CI90_upper")], rel=1e-9)
