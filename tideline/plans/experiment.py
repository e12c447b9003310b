"""Nested selection and forecasting as one DataFrame plan.

A fit depends on its training window and the candidate, not on the cell that
asks for it, so every (split, candidate) is fitted once and shared by all cells
and scopes. Kernels run in grouped pandas functions, one group a window; what
can't be fitted gives no row, and errors come back as rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import child_seed
from ..functions.tables import hold, literal_table
from ..kernels import bvar, ridge
from ..operators import losses, selection
from ..schemas import CELL
from ..shipping import ship
from . import planning


@dataclass(frozen=True)
class Study:
    variables: tuple[str, ...]
    horizons: tuple[int, ...] = (1, 2, 3, 4)
    scopes: tuple[str, ...] = ("pooled", "horizon", "variable", "variable_horizon")
    lam: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)
    p: tuple[int, ...] = (1, 2)
    alpha: tuple[float, ...] = (1.0,)
    kappa: tuple[float, ...] = (1.0,)
    n_outer: int = 8
    n_inner: int = 4
    min_train: int = 30
    every: int | None = None  # None: select once
    method: str = "iterated"
    kernel: Callable | None = None  # own forecaster (y, p, lam, alpha, kappa, horizons) -> (horizons, n) or None; ridge where None
    loss: losses.LossConfig = field(default_factory=losses.LossConfig)


def fitted(windows: DataFrame, grid: list[tuple], study: Study, by: list[str]) -> DataFrame:
    """Forecasts of every wanted candidate for each window: (by..., candidate, variable, horizon, forecast).

    ``windows``: long rows (by..., row_idx, variable, value) of each window,
    with ``wanted``, an array of candidate numbers.
    """
    ship(windows.sparkSession)
    variables, horizons, method, own = list(study.variables), list(study.horizons), study.method, study.kernel
    kinds = dict(windows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", candidate int, variable string, horizon int, forecast double"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.pivot(index="row_idx", columns="variable", values="value").sort_index()[variables].to_numpy(float)
        out = []
        for k in sorted({int(c) for c in rows["wanted"].iloc[0]}):
            lam, p, alpha, kappa = grid[k]
            got = own(y, p, lam, alpha, kappa, horizons) if own else ridge.forecast(y, p, lam, alpha, kappa, horizons, method)
            if got is not None:
                out += [(*key, k, v, h, float(got[i, j])) for i, h in enumerate(horizons) for j, v in enumerate(variables)]
        return pd.DataFrame(out, columns=[*by, "candidate", "variable", "horizon", "forecast"])

    return windows.groupBy(*by).applyInPandas(one, schema)


def history(origins: DataFrame, panel: DataFrame) -> DataFrame:
    """Panel rows up to each origin: its positions are listed and met by an equality, not compared row by row."""
    return origins.withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.col("origin").cast("int")))).join(panel, "row_idx")


def scope_grid(panel: DataFrame, study: Study) -> tuple[DataFrame, DataFrame]:
    """(selections, forecasts) for all scopes. ``panel``: long (row_idx, variable, value), complete."""
    spark = panel.sparkSession
    panel = hold(panel.filter(F.col("variable").isin(list(study.variables))))  # read by every stage below; recomputed if an executor is lost
    last = panel.agg(F.max("row_idx")).first()[0]
    longest = max(study.horizons)
    outer = [last - longest - k for k in range(study.n_outer)][::-1]
    origins = literal_table(spark, list(enumerate(outer)), "idx int, origin int")
    events = planning.selection_events(origins, study.every)
    at = events.join(origins, events.applies_from == origins.idx).select("event_id", F.col("origin").alias("cutoff"))

    candidates = planning.grid(spark, study.lam, study.p, study.alpha, study.kappa)
    rows = [(r.lam, r.p, r.alpha, r.kappa) for r in candidates.orderBy("candidate").collect()]  # the configuration's own grid
    targets = planning.targets(literal_table(spark, [(v,) for v in study.variables], "variable string"), literal_table(spark, [(h,) for h in study.horizons], "horizon int"))
    plan = planning.selection_plan(targets, study.scopes)

    splits = planning.validation_splits(at.select("cutoff").distinct(), {h: h for h in study.horizons}, study.min_train, study.n_inner)
    inner = planning.training_rows(panel, splits).select("split_id", "row_idx", "variable", "value").distinct().withColumn("wanted", F.array(*[F.lit(k) for k in range(len(rows))]))
    made = fitted(inner, rows, study, ["split_id"])  # a split is fitted once, however many events use it
    scored = planning.target_rows(panel, splits).select("split_id", "cutoff", "horizon", "variable", F.col("value").alias("realization"))
    records = made.join(scored, ["split_id", "variable", "horizon"]).withColumn("raw_error", F.col("realization") - F.col("forecast"))
    in_cells = records.join(plan, CELL)
    by = ["cutoff", "scope", "cell_id", "candidate"]
    full = plan.groupBy("scope", "cell_id").agg((F.count(F.lit(1)) * study.n_inner).alias("need"))
    values = losses.selection_loss(in_cells, study.loss, by).join(full, ["scope", "cell_id"]).filter(F.col("n_records") == F.col("need"))  # a candidate that fails anywhere in a cell is out of it
    chosen = selection.best_candidate(values.withColumnRenamed("selection_loss", "loss").join(candidates, "candidate"), ["cutoff", "scope", "cell_id"])
    selections = at.join(chosen, "cutoff").select("event_id", "cutoff", "scope", "cell_id", "lam", "p", "alpha", "kappa", F.col("loss").alias("selection_loss"), "n_tied")

    of_origin = planning.event_of_origin(origins, events).select("origin", "event_id")
    picks = of_origin.join(selections, "event_id").join(candidates, ["lam", "p", "alpha", "kappa"]).select("origin", "event_id", "scope", "cell_id", "candidate")
    wanted = picks.groupBy("origin").agg(F.array_distinct(F.collect_list("candidate")).alias("wanted"))  # at most the grid
    blocks = history(wanted, panel).select("origin", "row_idx", "variable", "value", "wanted")
    outer_fits = fitted(blocks, rows, study, ["origin"])
    forecasts = picks.join(plan, ["scope", "cell_id"]).join(outer_fits, ["origin", "candidate", "variable", "horizon"])
    actual = panel.select(F.col("row_idx").alias("target"), "variable", F.col("value").alias("actual"))
    # A target without an actual stays, without an error.
    panel_out = forecasts.withColumn("target", F.col("origin") + F.col("horizon")).join(actual, ["target", "variable"], "left").withColumn("error", F.col("forecast") - F.col("actual"))
    return selections, panel_out.select("scope", "cell_id", "event_id", "candidate", "origin", "target", "variable", "horizon", "forecast", "actual", "error")


BENCHMARKS = ("no_change", "var_aic", "var_bic", "var_nested_loss", "ar_univariate")


def benchmarks(panel: DataFrame, study: Study, kinds: tuple[str, ...] = ("no_change", "var_aic", "var_bic", "ar_univariate")) -> DataFrame:
    """(model, origin, variable, horizon, forecast, lag) of the benchmarks at the outer origins.

    ``var_nested_loss`` is a least-squares VAR whose lag has the smallest loss
    in the inner splits before each origin; the others look at the window alone.
    """
    ship(panel.sparkSession)
    spark, variables, horizons = panel.sparkSession, list(study.variables), list(study.horizons)
    if unknown := set(kinds) - set(BENCHMARKS):
        raise ValueError(f"no benchmark {', '.join(sorted(unknown))}")
    simple = [k for k in kinds if k != "var_nested_loss"]
    panel = panel.filter(F.col("variable").isin(variables))
    last = panel.agg(F.max("row_idx")).first()[0]
    origins = literal_table(spark, [(last - max(horizons) - k,) for k in range(study.n_outer)], "origin int")
    schema = "model string, origin int, variable string, horizon int, forecast double, lag int"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.pivot(index="row_idx", columns="variable", values="value").sort_index()[variables].to_numpy(float)
        out = []
        for kind in simple:
            got, lags = ridge.benchmark(y, kind, horizons)
            if got is not None:
                out += [(kind, int(key[0]), v, h, float(got[i, j]), lags[j]) for i, h in enumerate(horizons) for j, v in enumerate(variables)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    found = history(origins, panel).groupBy("origin").applyInPandas(one, schema)
    if "var_nested_loss" not in kinds:
        return found
    nested = replace(study, scopes=("pooled",), lam=(0.0,), p=tuple(range(1, ridge.MAX_LAG + 1)), alpha=(0.0,), kappa=(1.0,), every=1, method="iterated", kernel=None)
    selections, forecasts = scope_grid(panel, nested)
    chosen = forecasts.join(selections.select("event_id", F.col("p").cast("int").alias("lag")), "event_id")
    return found.unionByName(chosen.select(F.lit("var_nested_loss").alias("model"), "origin", "variable", "horizon", "forecast", "lag"))


def bayesian_forecasts(panel: DataFrame, study: Study, lags: int = 2, draws: int = 200, hyperparameters: str = "mode", seed: int = 0) -> DataFrame:
    """Predictive draws at the outer origins: (origin, draw, variable, horizon, value, error).

    Hyperparameters at their posterior mode, by Metropolis draws, or fixed. A
    failing origin gives one row with its error.
    """
    ship(panel.sparkSession)
    spark, variables, horizons = panel.sparkSession, list(study.variables), list(study.horizons)
    panel = panel.filter(F.col("variable").isin(variables))
    last = panel.agg(F.max("row_idx")).first()[0]
    origins = literal_table(spark, [(last - max(horizons) - k,) for k in range(study.n_outer)], "origin int")
    schema = "origin int, draw int, variable string, horizon int, value double, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        origin = int(key[0])
        try:
            y = rows.pivot(index="row_idx", columns="variable", values="value").sort_index()[variables].to_numpy(float)
            c, rng = bvar.context(y, lags), np.random.Generator(np.random.PCG64(child_seed(seed, "draws", origin)))
            at = np.array([0.2, 1.0, 1.0]) if hyperparameters == "fixed" else bvar.mode(c)
            points = bvar.metropolis(c, at, draws, draws // 2, rng)[0] if hyperparameters == "metropolis" else [at] * draws
            paths = [bvar.predictive(c, v, max(horizons), rng) for v in points]
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as failure:
            return pd.DataFrame([(origin, None, None, None, None, f"{type(failure).__name__}: {failure}")], columns=names)
        return pd.DataFrame([(origin, d, v, h, float(path[h - 1, j]), None) for d, path in enumerate(paths) for h in horizons for j, v in enumerate(variables)], columns=names)

    return history(origins, panel).groupBy("origin").applyInPandas(one, schema)
