import math

import numpy as np
import pytest

from tideline.kernels import bvar, ridge
from tideline.plans import experiment


def var1(steps, seed=0, scale=0.1):
    rng = np.random.default_rng(seed)
    a, c = np.array([[0.6, 0.1, 0], [-0.1, 0.5, 0.1], [0, 0.1, 0.4]]), np.array([0.2, -0.1, 0.1])
    y = [np.zeros(3)]
    for _ in range(steps - 1):
        y.append(c + a @ y[-1] + scale * rng.standard_normal(3))
    return np.array(y)


def test_design_by_hand():
    x, y = ridge.design(np.array([[1.0, 10], [2, 20], [3, 30], [4, 40]]), 2)
    assert x.tolist() == [[1, 2, 20, 1, 10], [1, 3, 30, 2, 20]] and y.tolist() == [[3, 30], [4, 40]]
    x, y = ridge.design(np.arange(8.0).reshape(-1, 1), 2, 3)
    assert len(x) == 8 - 3 - 2 + 1 and y[0, 0] == 4


def test_no_penalty_is_least_squares_and_penalties_shrink():
    y = var1(120)
    x, t = ridge.design(y, 2)
    assert np.allclose(ridge.fit(y, 2, 0.0).coefficients, np.linalg.lstsq(x, t, rcond=None)[0])
    assert np.allclose(ridge.fit(y, 2, 1e-12, 1.0, 2.0).coefficients, ridge.fit(y, 2, 0.0).coefficients, atol=1e-6)
    lam, d = 3.0, ridge.penalties(3, 2, 1.0, 2.0)
    b = ridge.fit(y, 2, lam, 1.0, 2.0).coefficients
    for j in range(3):
        assert np.allclose((x.T @ x + lam * np.diag(d[:, j])) @ b[:, j], x.T @ t[:, j])
    assert np.abs(ridge.fit(y, 2, 1e9).coefficients[1:]).max() < 1e-6
    assert d[0].tolist() == [0, 0, 0] and d[1].tolist() == [1, 2, 2] and d[4].tolist() == [2, 4, 4]


def test_direct_equals_iterated_at_one_step():
    y = var1(80)
    for kappa in (1.0, 2.0):
        assert np.allclose(ridge.forecast(y, 2, 1.0, 1.0, kappa, [1], "direct"), ridge.forecast(y, 2, 1.0, 1.0, kappa, [1]))
    f = ridge.fit(y, 1, 0.0)
    two = ridge.iterate(f, y, 2)
    assert np.allclose(two[1], f.coefficients[0] + two[0] @ f.coefficients[1:]) and f.stable
    assert ridge.forecast(y[:2], 4, 1.0, 1.0, 1.0, [1]) is None


def test_evidence_equals_a_student_density():
    """One observation of one variable: Y | X is t with d degrees around x b."""
    x, y = np.array([[1.0, 0.7]]), np.array([[0.9]])
    b, omega, psi = np.array([[0.0], [1.0]]), np.array([2.0, 0.5]), np.array([0.3])
    d = 3
    scale = psi[0] * (1 + (x[0] ** 2 * omega).sum()) / d
    z = (y[0, 0] - (x @ b)[0, 0]) ** 2 / scale / d
    want = math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(d * math.pi * scale) - (d + 1) / 2 * math.log1p(z)
    assert bvar.log_evidence(x, y, b, omega, psi) == pytest.approx(want)


def test_mode_and_draws():
    c = bvar.context(var1(90), 2)
    at = bvar.mode(c)
    assert np.isfinite(bvar.log_posterior(c, at)) and bvar.log_posterior(c, at) >= bvar.log_posterior(c, np.array([0.2, 1.0, 1.0])) - 1e-6
    assert bvar.log_posterior(c, np.array([6.0, 1, 1])) == -np.inf
    points, rate = bvar.metropolis(c, at, 50, 20, np.random.default_rng(1))
    assert points.shape == (50, 3) and 0 <= rate <= 1
    mean = bvar.predictive(c, at, 4, None)
    paths = np.array([bvar.predictive(c, at, 4, np.random.default_rng(k)) for k in range(300)])
    assert np.abs(paths.mean(axis=0) - mean).max() < 0.1
    best, value = bvar.search(lambda q: np.inf if q[0] < 2 else (q[0] - 3) ** 2, [(1,), (2,), (3,), (4,)])
    assert best == (3,) and value == 0
    with pytest.raises(ValueError):
        bvar.search(lambda q: np.nan, [(1,)])
    low, _ = bvar.simplex(lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2, np.zeros(2))
    assert np.allclose(low, [1, -2], atol=1e-2)


def long_panel(spark, y):
    return spark.createDataFrame([(i, v, float(y[i, j])) for i in range(len(y)) for j, v in enumerate(("gdp", "inv", "cons"))], "row_idx int, variable string, value double")


def test_scope_study_counts(spark):
    panel = long_panel(spark, var1(120, 42, 0.15))
    study = experiment.Study(variables=("gdp", "inv", "cons"))
    selections, forecasts = experiment.scope_grid(panel, study)
    counts = {r.scope: r["count"] for r in selections.groupBy("scope").count().collect()}
    assert counts == {"pooled": 1, "horizon": 4, "variable": 3, "variable_horizon": 12}
    rows = forecasts.collect()
    assert len(rows) == 4 * 96
    again = experiment.Study(variables=study.variables, every=2, method="direct")
    counts = {r.scope: r["count"] for r in experiment.scope_grid(panel, again)[0].groupBy("scope").count().collect()}
    assert counts == {"pooled": 4, "horizon": 16, "variable": 12, "variable_horizon": 48}
    # One forecast recomputed from its own past alone.
    y, r = var1(120, 42, 0.15), rows[0]
    lam, p, alpha, kappa = [(c.lam, c.p, c.alpha, c.kappa) for c in selections.filter(f"scope = '{r.scope}' and cell_id = '{r.cell_id}'").collect()][0]
    want = ridge.forecast(y[: r.origin + 1], p, lam, alpha, kappa, [r.horizon])[0, ("gdp", "inv", "cons").index(r.variable)]
    assert r.forecast == pytest.approx(want) and r.actual == pytest.approx(y[r.target, ("gdp", "inv", "cons").index(r.variable)])


def test_selection_equals_a_plain_loop(spark):
    y = var1(70, 3)
    study = experiment.Study(variables=("gdp", "inv", "cons"), horizons=(1, 2), scopes=("pooled", "variable"), n_outer=2, n_inner=3)
    selections, _ = experiment.scope_grid(long_panel(spark, y), study)
    cutoff = 69 - 2 - 1
    names = list(study.variables)
    for r in selections.collect():
        assert r.cutoff == cutoff
        columns = range(3) if r.scope == "pooled" else [names.index(r.cell_id.removeprefix("variable-"))]
        best = None
        for p in study.p:
            for lam in sorted(study.lam, reverse=True):
                cells = {}
                for k in range(study.n_inner):
                    o = cutoff - 2 - k
                    got = ridge.forecast(y[: o + 1], p, lam, 1.0, 1.0, [1, 2])
                    for i, h in enumerate((1, 2)):
                        for j in columns:
                            cells.setdefault((j, h), []).append((got[i, j] - y[o + h, j]) ** 2)
                loss = math.sqrt(np.mean([np.mean(v) for v in cells.values()]))
                best = min(best or (np.inf, 0, 0), (loss, p, -lam))
        assert r.selection_loss == pytest.approx(best[0]) and (r.p, -r.lam) == best[1:]


def test_benchmarks_and_failures_as_rows(spark):
    y = var1(60, 1)
    study = experiment.Study(variables=("gdp", "inv", "cons"), horizons=(1, 2), n_outer=3)
    got = experiment.benchmarks(long_panel(spark, y), study).collect()
    assert len(got) == 4 * 3 * 2 * 3
    assert all(r.forecast == pytest.approx(y[r.origin, list(study.variables).index(r.variable)]) for r in got if r.model == "no_change")
    short = experiment.bayesian_forecasts(long_panel(spark, y[:6]), study, lags=5, draws=2).collect()
    assert short and all(r.error is None or ":" in r.error for r in short)
