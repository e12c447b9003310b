"""Planning tables: cells, events, splits, grids, calendars, jobs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.tables import literal_table
from ..schemas import DataError

SCOPES = ("pooled", "horizon", "variable", "variable_horizon", "group", "group_horizon")


def targets(variables: DataFrame, horizons: DataFrame) -> DataFrame:
    """Every (variable, horizon): the product of two configuration lists."""
    return variables.select("variable").crossJoin(F.broadcast(horizons.select("horizon")))  # a configuration's horizons


def grouped_variables(variables: DataFrame, groups: dict[str, list[str]], residual: str = "other") -> DataFrame:
    """(variable, group): variables of no explicit group form the residual one."""
    scalars.parse_groups(";".join(f"{k}={'+'.join(v)}" for k, v in groups.items()))  # rejects overlaps
    name = F.lit(residual)
    for g, members in groups.items():
        name = F.when(F.col("variable").isin(members), g).otherwise(name)
    return variables.select("variable", name.alias("group"))


def selection_plan(wanted: DataFrame, scopes=SCOPES[:4], groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(scope, cell_id, variable, horizon): each scope partitions the targets."""
    if bad := set(scopes) - set(SCOPES):
        raise DataError(f"unknown scopes {bad}")
    base = wanted.join(grouped_variables(wanted.select("variable").distinct(), groups), "variable") if groups else wanted.withColumn("group", F.lit(None).cast("string"))
    ids = F.map_from_arrays(F.array(*[F.lit(s) for s in scopes]), F.array(*[scalars.cell_id(s, F.col("variable"), F.col("horizon"), F.coalesce("group", "variable")) for s in scopes]))
    return base.select("variable", "horizon", F.explode(ids).alias("scope", "cell_id"))


def selection_events(origins: DataFrame, every: int | None = None, explicit: list[int] | None = None) -> DataFrame:
    """Event rows over origins (column idx, 0 the first): once, every n-th, or explicit ones; each applies until the next."""
    if explicit is not None:
        if not explicit or 0 not in explicit:
            raise DataError("the first origin must select")
        chosen = origins.filter(F.col("idx").isin(sorted(set(explicit))))
    else:
        chosen = origins.filter(F.col("idx") % every == 0) if every else origins.filter("idx = 0")
    order = Window.partitionBy(F.lit(0)).orderBy("idx")  # events are few: a schedule, not data
    last = origins.agg(F.max("idx").alias("last"))
    events = chosen.join(F.broadcast(last)).withColumn("event", F.row_number().over(order) - 1)  # one row
    return events.select(scalars.event_id(F.col("event"), F.col("idx")).alias("event_id"), F.col("idx").alias("applies_from"), (F.coalesce(F.lead("idx").over(order), F.col("last") + 1) - 1).alias("applies_to"))


def event_of_origin(origins: DataFrame, events: DataFrame) -> DataFrame:
    """The event whose span holds each origin; spans are listed, so origins meet them by an equality."""
    return origins.join(events.withColumn("idx", F.explode(F.sequence(F.col("applies_from").cast("int"), F.col("applies_to").cast("int")))), "idx").select(*origins.columns, *events.columns)


def carry_forward(selected: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Choices made at events, carried to the origins after them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return selected.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def validation_splits(cutoffs: DataFrame, offsets: dict[int, int], min_train: int, n_splits: int, stride: int = 1, window: int | None = None, decay: float | None = None) -> DataFrame:
    """Inner splits for each cutoff (column ``cutoff``, the last known row).

    Origins lie on a grid that ends at cutoff less the longest offset; each
    trains on all rows up to it, or on the last ``window``. The ``n_splits``
    most recent are kept; a cutoff with fewer is an error where it is read.
    """
    longest = max(offsets.values())
    first = max(min_train, window or 0) - 1
    top = F.col("cutoff") - longest
    enough = F.when(top - (n_splits - 1) * stride >= first, top).otherwise(F.raise_error(F.concat(F.lit("too few splits at cutoff "), F.col("cutoff").cast("string"))).cast("int"))
    rows = cutoffs.select("cutoff", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda k: enough - k * stride)).alias("rank", "origin"))
    start = F.greatest(F.col("origin") - window + 1, F.lit(0)) if window else F.lit(0)
    reach = F.map_from_entries(F.array(*[F.struct(F.lit(h), (F.col("origin") + o)) for h, o in sorted(offsets.items())]))
    weight = F.pow(F.lit(decay), F.col("rank")) / sum(decay**k for k in range(n_splits)) if decay else F.lit(1.0)
    return rows.select("cutoff", scalars.split_id(F.col("origin")).alias("split_id"), start.cast("int").alias("train_start"), F.col("origin").alias("train_end"), "origin", reach.alias("targets"), F.col("cutoff").alias("info_cutoff"), weight.alias("origin_weight"))


def training_rows(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Panel rows (row_idx) of each split's training window; a window's positions are listed, so rows meet them by an equality."""
    places = splits.select("split_id", "cutoff", "train_start", "train_end", F.explode(F.sequence(F.col("train_start").cast("int"), F.col("train_end").cast("int"))).alias("row_idx"))
    return places.join(panel, "row_idx")


def target_rows(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """The panel row that each split and horizon is scored on."""
    want = splits.select("split_id", "cutoff", "origin", F.explode("targets").alias("horizon", "target"))
    return want.join(panel, F.col("target") == F.col("row_idx"))


def grid(spark: SparkSession, lam=(0.01, 0.1, 1.0, 10.0, 100.0, 1000.0), p=(1, 2, 4), alpha=(0.0, 1.0, 2.0), kappa=(1.0, 2.0)) -> DataFrame:
    """Candidates: the product of the distinct values of each hyperparameter, numbered."""
    rows = list(product(*(sorted(set(v)) for v in (lam, p, alpha, kappa))))
    return literal_table(spark, [(i, float(a), int(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(rows)], "candidate int, lam double, p int, alpha double, kappa double")


def month_ends(spark: SparkSession, first: str, last: str, months: int = 1) -> DataFrame:
    """Ends of every ``months``-th month from ``first`` to ``last`` (dates)."""
    return spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr(f"interval {months} month"))).alias("m")).select(F.last_day("m").alias("origin")).filter(F.col("origin") <= F.lit(last).cast("date"))


def jobs(spark: SparkSession, config: dict) -> DataFrame:
    """One row for each family x scope x variant x seed that a declarative configuration asks for."""
    rows = []
    for family, part in sorted(config.items()):
        for scope, variant, seed in product(part.get("scopes", ["pooled"]), part.get("variants", ["default"]), part.get("seeds", [0])):
            rows.append((f"{family}-{scope}-{variant}-s{seed}", family, scope, variant, int(seed), scalars.stable_hash([family, scope, variant, seed, part.get("settings", {})])))
    return literal_table(spark, rows, "job_id string, family string, scope string, variant string, seed int, configuration_hash string")


def chosen_jobs(jobs_table: DataFrame, index: list[int] | None = None, **criteria) -> DataFrame:
    """Jobs that meet all criteria (a value or several, for any column), and of these the ones at the given places by id."""
    for name, value in criteria.items():
        if value is not None:
            jobs_table = jobs_table.filter(F.col(name).isin(list(value) if isinstance(value, (list, tuple, set)) else [value]))
    if index is None:
        return jobs_table
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("job_id")) - 1  # a configuration's jobs
    return jobs_table.withColumn("_place", place).filter(F.col("_place").isin(index)).drop("_place")


#: Which vintage the inner splits of an outer origin read.
VINTAGE_POLICIES = ("outer_vintage_consistent", "strict_inner_real_time")


def split_vintages(splits: DataFrame, policy: str = "outer_vintage_consistent") -> DataFrame:
    """``splits`` with the vintage that each is trained on: the outer cutoff's, or the split's own origin's."""
    if policy not in VINTAGE_POLICIES:
        raise DataError(f"no vintage policy {policy!r}")
    return splits.withColumn("vintage", F.col("cutoff") if policy == VINTAGE_POLICIES[0] else F.col("origin"))


def objective_variables(variables: list[str], forecast: list[str] | None = None, objective: list[str] | None = None) -> tuple[list[str], list[str]]:
    """What is forecast, and what of it is scored: each a part of what the one before holds, in its order; all of it where not given."""
    out, held = [], list(variables)
    for asked, what in ((forecast, "forecast"), (objective, "objective")):
        asked = held if asked is None else asked
        if not asked or len(set(asked)) != len(asked) or set(asked) - set(held):
            raise DataError(f"{what} variables must be some of {', '.join(held)}, each once")
        held = [v for v in held if v in set(asked)]
        out.append(held)
    return out[0], out[1]


def fit_counts(events: int, cells: int, candidates: int, inner: int, outer: int) -> dict[str, int]:
    """Fits of a nested study that refits for each cell, and of one that shares fits between cells."""
    return {"per_cell": events * cells * candidates * inner + outer * cells, "shared": events * candidates * inner + outer * cells}


def parse_schedule(token: str) -> int | None:
    """``once``, ``per_origin``, ``annual`` (every 4 quarters) or a number of origins, as ``every`` of the events."""
    named = {"once": None, "per_origin": 1, "annual": 4}
    if token in named:
        return named[token]
    if not token.isdigit() or int(token) < 1:
        raise DataError(f"unknown schedule {token!r}")
    return int(token)


#: Strategies that select on the first origin only, and on every origin.
SCHEDULES = {"marginal_likelihood": "per_origin", "rmse": "once", "fixed": "once"}


def study_warnings(budget: int, dimensions: int, inner_origins: int, absolute_scales: bool = False) -> list[str]:
    """What makes a study's selections unsure."""
    found = []
    if budget < max(24, 8 * dimensions):
        found.append(f"{budget} evaluations are few for {dimensions} dimensions")
    if inner_origins < 8:
        found.append(f"{inner_origins} inner origins are few")
    if absolute_scales:
        found.append("absolute residual scales leak between folds")
    return found
