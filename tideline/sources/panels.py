"""Readers of panels, runs and metadata, and the sinks. Paths may be in any store that Spark reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks
from ..schemas import BACKFILL, CELL, DRAWS_PANEL, METRIC_PANEL, OBSERVATION, VINTAGE, DataError, nan_to_null, require


def wide_csv(spark: SparkSession, path: str, variables: list[str], date_column: str | None = None) -> DataFrame:
    """A panel with one column for each variable and a row index in date (or file) order."""
    head = spark.read.csv(path, header=True).columns
    require_columns = [c for c in [*variables, *([date_column] if date_column else [])] if c not in head]
    if require_columns:
        raise DataError(f"{path} lacks {require_columns}")
    raw = spark.read.csv(path, header=True)
    label = F.col(date_column) if date_column else F.monotonically_increasing_id().cast("string")
    order = F.col("label") if date_column else F.col("label").cast("long")
    rows = raw.select(label.alias("label"), *[F.col(f"`{v}`").try_cast("double").alias(v) for v in variables])
    return nan_to_null(rows).withColumn("row_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)  # a wide panel has a row for each period


def long_form(wide: DataFrame, variables: list[str]) -> DataFrame:
    return wide.unpivot(["row_idx", "label"], variables, "variable", "value")


def vintage_panel(spark: SparkSession, path: str, backfill: bool = False, validate: bool = True) -> DataFrame:
    schema = T.StructType([*VINTAGE.fields, *(BACKFILL.fields if backfill else [])])
    panel = nan_to_null(spark.read.schema(schema).csv(path, header=True, enforceSchema=False))
    if backfill:
        panel = panel.withColumn("is_synthesized", F.coalesce("is_synthesized", F.lit(False)))
    if validate:
        checks.enforce(checks.vintage_violations(panel).filter("n_missing > 0 or n_future > 0 or n_repeated > 0"), "vintage panel")
    return panel


def two_column_text(df: DataFrame, text: str = "value") -> DataFrame:
    """Lines ``date,value``: parsed with nulls for what can't be, which are dropped."""
    parts = F.split(F.col(text), ",")
    return df.select(F.expr(f"try_to_date(split({text}, ',')[0])").alias("observation_date"), F.get(parts, F.lit(1)).try_cast("double").alias("value")).filter("observation_date is not null and value is not null and not isnan(value)")


@dataclass(frozen=True)
class PanelSpec:
    model: str
    family: str | None = None
    size: str | None = None
    scope: str | None = None
    selection: str | None = None
    forecast_method: str | None = None


def adapt(raw: DataFrame, spec: PanelSpec) -> DataFrame:
    """Either run layout as a canonical panel; refuses repeated keys. The error defaults to forecast less actual."""
    metric = "mean_metric" in raw.columns
    names = {"forecast": "mean_metric", "actual": "actual_metric", "error": "error_metric"} if metric else {"forecast": "mean", "actual": "actual", "error": "error"}
    require(raw, ["forecast_origin", "target_quarter", "horizon_quarters", "variable", names["forecast"], names["actual"]], spec.model)
    forecast, actual = F.col(names["forecast"]).cast("double"), F.col(names["actual"]).cast("double")
    error = F.coalesce(F.col(names["error"]).cast("double"), forecast - actual) if names["error"] in raw.columns else forecast - actual
    origin = F.col("forecast_origin").cast("string")
    panel = raw.select(
        F.lit(spec.model).alias("model"), *[F.lit(getattr(spec, t)).cast("string").alias(t) for t in ("family", "size", "scope", "selection")],
        F.coalesce(F.lit(spec.forecast_method).cast("string"), F.col("forecast_method") if "forecast_method" in raw.columns else F.lit(None)).alias("forecast_method"),
        (F.coalesce("group", F.lit("all")) if "group" in raw.columns else F.lit("all")).alias("group"), origin.alias("forecast_origin"),
        F.coalesce(origin.try_cast("long"), F.unix_date(origin.try_cast("date")).cast("long")).alias("origin_ord"), F.col("target_quarter").cast("string").alias("target"),
        F.col("horizon_quarters").cast("int").alias("horizon"), "variable", forecast.alias("forecast"), actual.alias("actual"), error.alias("error"),
    )
    panel = nan_to_null(panel)
    checks.enforce(checks.duplicate_keys(panel, CELL + OBSERVATION), f"{spec.model}: repeated keys")
    return panel


def forecast_panel(spark: SparkSession, path: str, spec: PanelSpec, layout: str = "metric") -> DataFrame:
    schema = METRIC_PANEL if layout == "metric" else DRAWS_PANEL
    raw = spark.read.csv(path, header=True)
    typed = raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema if f.name in raw.columns])
    if typed.isEmpty():
        raise DataError(f"{path} has no rows")
    return adapt(typed, spec)


def combine(panels: list[DataFrame], tolerance: float = 1e-6) -> DataFrame:
    """All panels in one; realisations of a key must agree between models."""
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    checks.enforce(checks.inconsistent_actuals(out, CELL + OBSERVATION, tolerance=tolerance), "realisations differ")
    return out.withColumn("sq_error", F.col("error") * F.col("error")).withColumn("abs_error", F.abs("error"))


def study(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """All panels that a JSON manifest names (its own list, not data)."""
    entries = spark.read.option("multiLine", True).json(manifest).select(F.explode("panels").alias("p")).select("p.*").collect()
    made = []
    for e in entries:
        e = e.asDict()
        made.append(forecast_panel(spark, f"{root}/{e['dir']}/forecast_panel.csv", PanelSpec(e["model"], *[e.get(k) for k in ("family", "size", "scope", "selection", "forecast_method")]), e.get("layout", "metric")))
    return combine(made)


def runs(spark: SparkSession, root: str, pattern: str = "*/forecast_panel.csv") -> DataFrame:
    """Rows of every run below ``root`` with the run's folder and, for ``h<N>q`` folders, its horizon."""
    raw = spark.read.csv(f"{root}/{pattern}", header=True)
    path = F.col("_metadata.file_path")
    return raw.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(path, r"(h\d+q)/[^/]+$", 1).alias("optimization_horizon"))


def failures(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.withColumn("stage", F.coalesce(F.col("stage"), F.lit("unknown"))) if "stage" in raw.columns else raw.withColumn("stage", F.lit("unknown"))


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, layout: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table; the committer makes it whole or not at all."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.option("header", True).csv(path) if layout == "csv" else writer.parquet(path)


def markdown(df: DataFrame, title: str, most: int = 500) -> str:
    """A report table of a result that is small by nature; refuses more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise DataError(f"{title}: more than {most} rows")
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(text(v) for v in r) + " |" for r in rows]
    return "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *lines, ""])


def latex(df: DataFrame, most: int = 500) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise DataError(f"more than {most} rows")
    body = [" & ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("_", r"\_") for v in r) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\ \hline", *body, r"\end{tabular}", ""])


# Runs ----------------------------------------------------------------------------------------------------------------


def latest_panel(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """A panel of newest values (series_id, observation_date, value); a key may stand once."""
    panel = nan_to_null(spark.read.schema(T.StructType([f for f in VINTAGE.fields if f.name != "vintage_date"])).csv(path, header=True, enforceSchema=False))
    if validate:
        checks.enforce(checks.duplicate_keys(panel, ["series_id", "observation_date"]), "latest panel")
    return panel


def _listing(spark: SparkSession, folder: str) -> dict[str, int]:
    """Sizes of what lies in a folder, by name; folders count as -1. Works in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        raise DataError(f"{folder} doesn't exist")
    return {s.getPath().getName(): -1 if s.isDirectory() else s.getLen() for s in fs.listStatus(place)}


RUN_FILES = ("forecast_panel.csv", "run_metadata.json")


def run_folders(spark: SparkSession, folder: str) -> list[str]:
    """The folder itself if it holds a run, else its children that do; a run of which a part is missing or empty is an error."""

    def state(held: dict[str, int]) -> str | None:
        """None where there is no run, ``""`` where it is whole, else what it lacks."""
        if not any(n in held for n in RUN_FILES):
            return None
        return ", ".join(f"{n} is {'missing' if n not in held else 'empty'}" for n in RUN_FILES if held.get(n, 0) in (0, 1))

    held = _listing(spark, folder)
    own = state(held)
    if own is not None:
        if own:
            raise DataError(f"incomplete run {folder}: {own}")
        return [folder]
    found = {n: state(_listing(spark, f"{folder}/{n}")) for n in sorted(held) if held[n] == -1}
    if broken := {n: s for n, s in found.items() if s}:
        raise DataError(f"incomplete runs below {folder}: " + "; ".join(f"{n}: {s}" for n, s in broken.items()))
    whole = [f"{folder}/{n}" for n, s in found.items() if s == ""]
    if not whole:
        raise DataError(f"no run in {folder}")
    return whole


def run_frame(spark: SparkSession, folder: str, strategy: str, name: str = "forecast_panel.csv") -> DataFrame | None:
    """Rows of a run's file with its model and horizon; the metadata must name the same strategy, and a file with a head alone is an error. None where the file is missing or empty."""
    import re

    told = run_metadata(spark, f"{folder}/run_metadata.json").first().asDict(recursive=True)  # one document
    if told.get("strategy") != strategy:
        raise DataError(f"{folder} holds {told.get('strategy')!r}, not {strategy!r}")
    by_name = re.search(r"/(h\d+q)/?$", folder)
    horizon = told.get("optimization_horizon") or (by_name[1] if by_name else None)
    if by_name and horizon != by_name[1]:
        raise DataError(f"{folder}: the folder and its metadata name different horizons")
    if _listing(spark, folder).get(name, 0) <= 1:
        return None
    rows = spark.read.csv(f"{folder}/{name}", header=True)
    if rows.isEmpty():
        raise DataError(f"{folder}/{name} has a head but no rows")
    return rows.withColumn("model", F.lit(strategy)).withColumn("optimization_horizon", F.lit(horizon).cast("string"))


def run_frames(spark: SparkSession, folders: dict[str, str], name: str = "forecast_panel.csv") -> DataFrame:
    """One file of all runs of several strategies (strategy -> folder), columns united by name."""
    made = [f for strategy, folder in folders.items() for run in run_folders(spark, folder) if (f := run_frame(spark, run, strategy, name)) is not None]
    if not made:
        raise DataError(f"no run has a {name}")
    out = made[0]
    for f in made[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def hyperparameters(spark: SparkSession, path: str) -> DataFrame:
    """Selected hyperparameters: numbers as numbers, ids and names as they are."""
    raw = spark.read.csv(path, header=True)
    require(raw, ["forecast_origin"], path)
    words = {"forecast_origin", "group", "strategy", "cell_id", "event_id", "model_size", "last_quarter", "psi"}
    return nan_to_null(raw.select(*[F.col(f"`{c}`") if c in words else F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns]))


def write_study(folder: str, tables: dict[str, DataFrame], orders: dict[str, list[str]], metadata: dict | None = None, layout: str = "csv") -> None:
    """A study's tables (selections, forecasts, failures, benchmarks ...) below one folder, each in a fixed order, and its metadata last.

    Whoever finds the metadata finds whole tables. Sorting happens here alone:
    a sort by range, so that the files one after another are in order.
    """
    for name, df in tables.items():
        if missing := [c for c in orders.get(name, []) if c not in df.columns]:
            raise DataError(f"{name} lacks {', '.join(missing)}")
        write_table(df.orderBy(*[F.col(c).asc_nulls_first() for c in orders[name]]) if orders.get(name) else df, f"{folder}/{name}", layout)
    if metadata is not None:
        import json

        spark = next(iter(tables.values())).sparkSession
        line = json.dumps(metadata, sort_keys=True, default=str)
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run_metadata")


def synthetic_panel(spark: SparkSession, steps: int = 120, seed: int = 42) -> DataFrame:
    """A stable three-variable autoregression in long form (row_idx, variable, value), for smoke runs."""
    import numpy as np

    # The coefficients, constants, spread and start of the smoke panel.
    a, c, spread = np.array([[0.6, 0.1, 0.0], [-0.1, 0.5, 0.1], [0.0, 0.1, 0.4]]), np.array([0.2, -0.1, 0.1]), 0.15
    rng, y, rows = np.random.Generator(np.random.PCG64(seed)), np.zeros(3), []
    for t in range(steps):
        y = c + a @ y + spread * rng.standard_normal(3)
        rows += [(t, v, float(x)) for v, x in zip(("gdp", "inv", "cons"), y)]
    return spark.createDataFrame(rows, "row_idx int, variable string, value double")
