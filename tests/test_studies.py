"""The registered studies take part with every series of the table."""

import math

import numpy as np
import pytest

from tideline.kernels import ridge
from tideline.plans import experiment
from tideline.plans.queries import GRID, QUERIES, predictive_summaries

from .conftest import MEDIUM
from .test_kernels import long_panel, var1


@pytest.mark.parametrize("name", ["ridge_scope_forecasts", "ridge_direct_forecasts", "benchmark_forecasts", "bayesian_forecasts", "bayesian_scope_forecasts"])
def test_every_series_is_forecast(spark, name):
    every = {r[0] for r in spark.read.parquet(f"{MEDIUM}/orders.parquet").select("o_orderpriority").distinct().collect()}
    assert len(every) == 5 and {r.variable for r in QUERIES[name](spark, MEDIUM).select("variable").distinct().collect()} == every


def test_every_series_is_selected_for(spark):
    cells = {r.cell_id for r in QUERIES["ridge_scope_selections"](spark, MEDIUM).filter("scope = 'variable'").collect()}
    assert cells == {"variable-1-urgent", "variable-2-high", "variable-3-medium", "variable-4-not-specified", "variable-5-low"}


def test_studies_run_at_full_size(spark):
    assert math.prod(map(len, GRID.values())) == 108
    rows = QUERIES["bayesian_forecasts"](spark, MEDIUM).collect()
    assert len(rows) == 8 * 5 * 4 and all(r.n_draws == 2000 and r.error is None and r.p05 < r.median < r.p95 for r in rows)


def test_failing_origins_stay_as_rows(spark):
    draws = spark.createDataFrame([(7, 0, "a", 1, 2.0, None), (7, 1, "a", 1, 4.0, None), (8, None, None, None, None, "LinAlgError: singular")], "origin int, draw int, variable string, horizon int, value double, error string")
    got = {r.origin: r for r in predictive_summaries(draws).collect()}
    assert (got[7].mean, got[7].n_draws, got[7].error) == (3.0, 2, None)
    assert (got[8].mean, got[8].n_draws, got[8].error) == (None, 0, "LinAlgError: singular")


def test_nested_lag_equals_a_plain_loop(spark):
    y = var1(60, 5)
    study = experiment.Study(variables=("gdp", "inv", "cons"), horizons=(1, 2), n_outer=2, n_inner=3)
    got = experiment.benchmarks(long_panel(spark, y), study, experiment.BENCHMARKS).collect()
    assert {r.model for r in got} == set(experiment.BENCHMARKS) and len(got) == 5 * 2 * 2 * 3
    for r in (r for r in got if r.model == "var_nested_loss"):
        losses = []
        for p in (1, 2, 3, 4):
            fits = [(o, ridge.forecast(y[: o + 1], p, 0.0, 0.0, 1.0, [1, 2])) for o in range(r.origin - 4, r.origin - 1)]
            losses.append((np.mean([(f[i] - y[o + h]) ** 2 for o, f in fits for i, h in enumerate((1, 2))]), p))
        assert r.lag == min(losses)[1]
        assert r.forecast == pytest.approx(ridge.forecast(y[: r.origin + 1], r.lag, 0.0, 0.0, 1.0, [r.horizon])[0, study.variables.index(r.variable)])
    with pytest.raises(ValueError, match="no benchmark"):
        ridge.benchmark(y, "var_other", [1])
