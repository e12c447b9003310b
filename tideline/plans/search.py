"""Searches for the hyperparameters of a Bayesian VAR, by evidence or by forecast loss, and forecasts with what they find.

A candidate is a point in a box. Residual scales are searched as multiples of
each training window's own scale, so one candidate means the same in every
window. Every (window, candidate) is evaluated once, in a grouped function, and
shared by all cells; a candidate that fails gives a row with its reason, and a
cell in which it fails gives it the penalty.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import child_seed
from ..functions.tables import hold, literal_table
from ..kernels import bvar
from ..operators import losses
from ..schemas import CELL, DataError
from ..shipping import ship
from . import planning
from .experiment import Study, history

# What an infeasible candidate scores, and how far residual scales may move, as logarithms of multiples.
PENALTY = 1e10
MULTIPLIERS = (math.log(0.01), math.log(100.0))
CORE = ("lam", "theta", "mu")
DEFAULTS = {"lam": 0.2, "theta": 1.0, "mu": 1.0}


@dataclass(frozen=True)
class SearchSpace:
    """``reduced`` searches the three shrinkages, ``full`` the residual scales too, ``custom`` what ``free`` names."""

    mode: str = "reduced"
    free: tuple[str, ...] = ()
    fixed: dict = field(default_factory=dict)  # value of a coordinate that isn't searched
    bounds: dict = field(default_factory=dict)  # (low, high) of one that is; else the kernel's box

    def __post_init__(self):
        if self.mode not in ("reduced", "full", "custom"):
            raise DataError(f"no search mode {self.mode!r}")
        if (self.mode == "custom") != bool(self.free):
            raise DataError("a custom search, and no other, names its free coordinates")
        if unknown := (set(self.free) | set(self.fixed) | set(self.bounds)) - {*CORE, "psi"}:
            raise DataError(f"no coordinates {', '.join(sorted(unknown))}")

    def names(self, variables: int) -> list[str]:
        """Searched coordinates; ``psi`` stands for one of each variable."""
        free = {"reduced": CORE, "full": (*CORE, "psi"), "custom": self.free}[self.mode]
        return [n for c in free if c not in self.fixed for n in ([c] if c != "psi" else [f"psi_{j}" for j in range(variables)])]

    def box(self, name: str) -> tuple[float, float]:
        kind = "psi" if name.startswith("psi") else name
        low, high = self.bounds.get(kind, MULTIPLIERS if kind == "psi" else bvar.BOUNDS[kind])
        if not low < high:
            raise DataError(f"empty box for {kind}")
        return low, high

    def candidates(self, variables: int, budget: int, seed: int = 0) -> list[dict[str, float]]:
        """The defaults, then seeded draws from the box: the same for a seed, whatever else is drawn elsewhere."""
        names = self.names(variables)
        if not names:
            raise DataError("nothing is left to search")
        rng = np.random.Generator(np.random.PCG64(child_seed(seed, "candidates", self.mode, *names)))
        low, high = np.array([self.box(n) for n in names]).reshape(-1, 2).T
        middle = {n: 0.0 if n.startswith("psi") else min(max(DEFAULTS[n], a), b) for n, a, b in zip(names, low, high)}
        return [middle, *({n: float(x) for n, x in zip(names, row)} for row in low + (high - low) * rng.random((max(0, budget - 1), len(names))))]


def natural(point: dict[str, float], c: bvar.Context, fixed: dict | None = None) -> np.ndarray:
    """The kernel's vector (lam, theta, mu and, where they are searched, scales) in a training window; ValueError outside the box."""
    values = DEFAULTS | (fixed or {}) | point
    moved = [values.get(f"psi_{j}", values.get("psi")) for j in range(len(c.scale))]
    core = [float(values[n]) for n in CORE]
    if all(m is None for m in moved):
        return np.array(core)
    steps = np.array([0.0 if m is None else float(m) for m in moved])
    if not np.isfinite(steps).all() or (steps <= MULTIPLIERS[0]).any() or (steps >= MULTIPLIERS[1]).any():
        raise ValueError("a residual scale lies outside its box")
    return np.r_[core, c.scale * np.exp(steps)]


def named(vector: np.ndarray, c: bvar.Context) -> dict[str, float]:
    """The inverse of :func:`natural`: shrinkages, and scales as logarithms of multiples of the window's."""
    out = dict(zip(CORE, map(float, vector[:3])))
    return out | {f"psi_{j}": float(np.log(s / c.scale[j])) for j, s in enumerate(vector[3:])}


def evaluated(windows: DataFrame, points: list[dict[str, float]], study: Study, by: list[str], lags: int, draws: int = 0, seed: int = 0, fixed: dict | None = None, wanted: str | None = None) -> DataFrame:
    """(by..., candidate, variable, horizon, forecast, evidence, reason) of every candidate in each window.

    Without ``draws`` the forecast is the path of the posterior mean; else the
    mean of that many simulated paths, from the same random numbers for every
    candidate of a window. ``wanted``: a column with the numbers to evaluate.
    """
    ship(windows.sparkSession)
    variables, horizons, kinds = list(study.variables), list(study.horizons), dict(windows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", candidate int, variable string, horizon int, forecast double, evidence double, reason string"
    names = [*by, "candidate", "variable", "horizon", "forecast", "evidence", "reason"]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.pivot(index="row_idx", columns="variable", values="value").sort_index()[variables].to_numpy(float)
        out = []
        for k in range(len(points)) if wanted is None else sorted({int(x) for x in rows[wanted].iloc[0]}):
            try:
                if len(y) < 2 * lags + 2:
                    raise ValueError("too few observations")
                c = bvar.context(y, lags)
                v = natural(points[k], c, fixed)
                level = bvar.log_posterior(c, v)
                if not np.isfinite(level):
                    raise ValueError("no finite evidence")
                rng = np.random.Generator(np.random.PCG64(child_seed(seed, "paths", *key)))
                paths = [bvar.predictive(c, v, max(horizons), rng) for _ in range(draws)] or [bvar.predictive(c, v, max(horizons), None)]
                path = np.mean(paths, axis=0)
                if not np.isfinite(path).all():
                    raise ValueError("a forecast isn't finite")
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as failure:
                out.append((*key, k, None, None, None, None, f"{type(failure).__name__}: {failure}"))
                continue
            out += [(*key, k, v_, h, float(path[h - 1, j]), float(level), None) for h in horizons for j, v_ in enumerate(variables)]
        return pd.DataFrame(out, columns=names)

    return windows.groupBy(*by).applyInPandas(one, schema)


def candidate_losses(made: DataFrame, panel: DataFrame, splits: DataFrame, plan: DataFrame, study: Study) -> DataFrame:
    """(cutoff, scope, cell_id, candidate, loss, failed, reason) from forecasts of inner splits.

    A candidate that fails in a split, or lacks a record of a cell, has the penalty and its first reason.
    """
    spots = splits.select("cutoff", "split_id").distinct()
    cells = plan.groupBy("scope", "cell_id").agg((F.count(F.lit(1)) * study.n_inner).alias("need"))
    scored = planning.target_rows(panel, splits).select("split_id", "cutoff", "horizon", "variable", F.col("value").alias("realization"))
    records = made.filter("reason is null").join(scored, ["split_id", "variable", "horizon"]).withColumn("raw_error", F.col("realization") - F.col("forecast")).join(plan, CELL)
    by = ["cutoff", "scope", "cell_id", "candidate"]
    values = losses.selection_loss(records, study.loss, by).select(*by, F.col("selection_loss").alias("value"), "n_records")
    faults = made.filter("reason is not null").join(spots, "split_id").groupBy("cutoff", "candidate").agg(F.min("reason").alias("reason"))
    every = made.select("split_id", "candidate").distinct().join(spots, "split_id").select("cutoff", "candidate").distinct().join(F.broadcast(cells))  # a configuration's cells
    whole = every.join(values, by, "left").join(faults, ["cutoff", "candidate"], "left")
    failed = F.col("reason").isNotNull() | F.col("value").isNull() | F.isnan("value") | (F.coalesce("n_records", F.lit(0)) != F.col("need"))
    return whole.select(*by, F.when(failed, F.lit(PENALTY)).otherwise(F.col("value")).alias("loss"), failed.alias("failed"), F.when(failed, F.coalesce("reason", F.lit("records missing"))).alias("reason"))


def best(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., candidate, loss): the least loss, the smaller number on ties; an error where every candidate has failed."""
    least = values.groupBy(*by).agg(F.min_by("candidate", F.struct("loss", "candidate")).alias("candidate"), F.min("loss").alias("loss"))
    label = F.concat_ws(" ", F.lit("no feasible candidate for"), *[F.col(c).cast("string") for c in by])
    return least.withColumn("loss", F.when(F.col("loss") < PENALTY, F.col("loss")).otherwise(F.raise_error(label).cast("double")))


def scope_search(panel: DataFrame, study: Study, space: SearchSpace, budget: int = 24, lags: int = 2, by_evidence: bool = False, draws: int = 0, seed: int = 0, diagnostics: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(losses, selections, forecasts) of all scopes; ``panel``: long (row_idx, variable, value), complete.

    ``by_evidence`` selects by the evidence of the window up to the cutoff, the
    same for all cells; else by loss over the inner splits. With
    ``diagnostics`` a cell's choice forecasts all targets, and ``is_canonical``
    marks its own.
    """
    spark = panel.sparkSession
    panel = hold(panel.filter(F.col("variable").isin(list(study.variables))))
    last = panel.agg(F.max("row_idx")).first()[0]
    outer = [last - max(study.horizons) - k for k in range(study.n_outer)][::-1]
    origins = literal_table(spark, list(enumerate(outer)), "idx int, origin int")
    events = planning.selection_events(origins, study.every)
    at = events.join(origins, events.applies_from == origins.idx).select("event_id", F.col("origin").alias("cutoff"))
    points = space.candidates(len(study.variables), budget, seed)
    targets = planning.targets(literal_table(spark, [(v,) for v in study.variables], "variable string"), literal_table(spark, [(h,) for h in study.horizons], "horizon int"))
    plan = planning.selection_plan(targets, study.scopes)

    if by_evidence:
        windows = history(at.select(F.col("cutoff").alias("origin")).distinct(), panel)
        made = evaluated(windows, points, study, ["origin"], lags, 0, seed, space.fixed)
        scores = made.groupBy(F.col("origin").alias("cutoff"), "candidate").agg(F.min("reason").alias("reason"), (-F.max("evidence")).alias("value"))
        cells = plan.select("scope", "cell_id").distinct()
        values = scores.join(F.broadcast(cells)).select("cutoff", "scope", "cell_id", "candidate", F.coalesce("value", F.lit(PENALTY)).alias("loss"), F.col("reason").isNotNull().alias("failed"), "reason")  # a configuration's cells
    else:
        splits = planning.validation_splits(at.select("cutoff").distinct(), {h: h for h in study.horizons}, study.min_train, study.n_inner)
        inner = planning.training_rows(panel, splits).select("split_id", "row_idx", "variable", "value").distinct()
        made = evaluated(inner, points, study, ["split_id"], lags, draws, seed, space.fixed)
        values = candidate_losses(made, panel, splits, plan, study)
    chosen = best(values, ["cutoff", "scope", "cell_id"])
    coordinates = literal_table(spark, [(k, n, x) for k, p in enumerate(points) for n, x in p.items()], "candidate int, name string, value double")
    selections = at.join(chosen, "cutoff").join(coordinates.groupBy("candidate").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("point")), "candidate")  # a candidate's coordinates

    picks = planning.event_of_origin(origins, events).select("origin", "event_id").join(selections.select("event_id", "scope", "cell_id", "candidate"), "event_id")
    wanted = picks.groupBy("origin").agg(F.array_distinct(F.collect_list("candidate")).alias("wanted"))  # at most the budget
    fits = evaluated(history(wanted, panel), points, study, ["origin"], lags, draws, seed, space.fixed, "wanted").filter("reason is null").drop("reason", "evidence")
    own = plan.withColumn("is_canonical", F.lit(True))
    asked = own if not diagnostics else plan.select("scope", "cell_id").distinct().join(F.broadcast(targets)).join(own, ["scope", "cell_id", *CELL], "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)))  # a configuration's targets
    actual = panel.select(F.col("row_idx").alias("target"), "variable", F.col("value").alias("actual"))
    out = picks.join(asked, ["scope", "cell_id"]).join(fits, ["origin", "candidate", *CELL]).withColumn("target", F.col("origin") + F.col("horizon"))
    out = out.join(actual, ["target", "variable"], "left").withColumn("error", F.col("forecast") - F.col("actual"))
    return values, selections.select("event_id", "cutoff", "scope", "cell_id", "candidate", "loss", "point"), out.select("scope", "cell_id", "event_id", "candidate", "origin", "target", *CELL, "is_canonical", "forecast", "actual", "error")


def generated(panel: DataFrame, tasks: DataFrame, generator: Callable, variables: list[str], horizons: list[int], seed: int = 0) -> DataFrame:
    """Draws of an own generator for tasks (task columns, origin, params map<string,double>): each task's row repeated for its draws.

    ``generator(y, params, horizons, rng)`` gives (draws, horizons, variables).
    Tasks that share origin and parameters share one run; the random numbers
    depend on these two alone. A run that fails gives one row with its error.
    """
    ship(panel.sparkSession)
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params"))))
    marked = tasks.withColumn("_key", key)
    runs = marked.groupBy("origin", "_key").agg(F.first("params").alias("params"))
    schema = "origin int, _key string, draw int, variable string, horizon int, value double, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            y = rows.pivot(index="row_idx", columns="variable", values="value").sort_index()[variables].to_numpy(float)
            got = np.asarray(generator(y, dict(rows["params"].iloc[0]), horizons, np.random.Generator(np.random.PCG64(child_seed(seed, "generated", *key)))), float)
            if got.ndim != 3 or got.shape[1:] != (len(horizons), len(variables)) or not np.isfinite(got).all():
                raise ValueError("draws of another shape, or not finite")
        except (ValueError, ArithmeticError, KeyError, np.linalg.LinAlgError) as failure:
            return pd.DataFrame([(*key, None, None, None, None, f"{type(failure).__name__}: {failure}")], columns=names)
        return pd.DataFrame([(*key, d, v, h, float(got[d, i, j]), None) for d in range(len(got)) for i, h in enumerate(horizons) for j, v in enumerate(variables)], columns=names)

    made = history(runs, panel.filter(F.col("variable").isin(variables))).groupBy("origin", "_key").applyInPandas(one, schema)
    return marked.join(made, ["origin", "_key"]).drop("_key")


def bvar_generator(lags: int = 2, draws: int = 200) -> Callable:
    """A generator of simulated paths at given hyperparameters."""

    def run(y, params, horizons, rng):
        c = bvar.context(y, lags)
        v = natural(params, c)
        return np.array([bvar.predictive(c, v, max(horizons), rng)[[h - 1 for h in horizons]] for _ in range(draws)])

    return run
