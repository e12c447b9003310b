"""Selection losses over forecast error records, and their parts.

Records: origin, variable, horizon, realization, raw_error (and benchmark_error
where the scale needs it); ``weight`` is the origin's weight, 1 where absent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import literal_table
from ..schemas import CELL, DataError


@dataclass(frozen=True)
class LossConfig:
    kind: str = "rmse"  # rmse, mse or mae
    scaling: str = "none"  # none, supplied, target_std or benchmark_rmse
    min_scale: float = 1e-8
    aggregation: str = "equal_cell"  # or equal_observation
    normalise: bool = True
    supplied: dict = field(default_factory=dict)  # (variable, horizon) -> scale
    cell_weights: dict = field(default_factory=dict)  # (variable, horizon) -> weight, 1 where absent

    def __post_init__(self):
        known = {"kind": ("rmse", "mse", "mae"), "scaling": ("none", "supplied", "target_std", "benchmark_rmse"), "aggregation": ("equal_cell", "equal_observation")}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise DataError(f"{name} {getattr(self, name)!r} is not one of {values}")


def _lookup(spark, table: dict, name: str) -> DataFrame:
    """A configuration's table; its rows are a configuration's entries, not data."""
    rows = [(str(v), int(h), float(x)) for (v, h), x in table.items()]
    return literal_table(spark, rows, f"variable string, horizon int, {name} double")


def cell_values(records: DataFrame, config: LossConfig, by: list[str] | None = None) -> DataFrame:
    """For each cell: weighted mean loss on scaled errors, n, scale and whether the floor was used."""
    by = by or []
    records = records if "weight" in records.columns else records.withColumn("weight", F.lit(1.0))
    raw = {
        "none": F.lit(1.0),
        "supplied": F.lit(None).cast("double"),
        "target_std": F.stddev_samp("realization"),
        "benchmark_rmse": F.sqrt(F.avg(F.col("benchmark_error") * F.col("benchmark_error"))) if "benchmark_error" in records.columns else F.lit(None).cast("double"),
    }[config.scaling]
    sums = records.groupBy(*by, *CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("_w"),
        F.sum(F.col("weight") * F.col("raw_error") * F.col("raw_error")).alias("_sq"), F.sum(F.col("weight") * F.abs("raw_error")).alias("_abs"), raw.alias("raw_scale"),
    )
    if config.scaling == "supplied":
        sums = sums.drop("raw_scale").join(F.broadcast(_lookup(records.sparkSession, config.supplied, "raw_scale")), CELL, "left")  # the configuration's own entries
    scale = F.when(F.col("raw_scale").isNull(), F.raise_error(F.concat(F.lit("no scale for "), F.col("variable"))).cast("double")).otherwise(F.greatest(F.col("raw_scale"), F.lit(config.min_scale)))
    value = F.col("_abs") / F.col("_w") / F.col("scale") if config.kind == "mae" else F.col("_sq") / F.col("_w") / F.col("scale") / F.col("scale")
    return sums.withColumn("scale", scale).select(*by, *CELL, "n", "scale", (F.col("raw_scale") < config.min_scale).alias("scale_floored"), value.alias("value"))


def cell_shares(records: DataFrame, config: LossConfig, by: list[str] | None = None) -> DataFrame:
    """Cell values with weight, contribution and its share of the total (0 where that is 0)."""
    by = by or []
    cells = cell_values(records, config, by)
    if config.cell_weights:
        cells = cells.join(F.broadcast(_lookup(records.sparkSession, config.cell_weights, "_cw")), CELL, "left")  # the configuration's own entries
    else:
        cells = cells.withColumn("_cw", F.lit(1.0))
    n = F.col("n") if config.aggregation == "equal_observation" else F.lit(1.0)
    cells = cells.withColumn("cell_weight", F.coalesce("_cw", F.lit(1.0)) * n).drop("_cw").withColumn("contribution", F.col("value") * F.col("cell_weight"))
    return cells.withColumn("share", F.coalesce(F.try_divide("contribution", F.sum("contribution").over(Window.partitionBy(*by))), F.lit(0.0)))


def selection_loss(records: DataFrame, config: LossConfig, by: list[str] | None = None) -> DataFrame:
    by = by or []
    total = F.sum("contribution")
    value = total / F.sum("cell_weight") if config.normalise else total
    return cell_shares(records, config, by).groupBy(*by).agg((F.sqrt(value) if config.kind == "rmse" else value).alias("selection_loss"), F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_records"))


def outer_metrics(records: DataFrame) -> DataFrame:
    """Unscaled RMSE and MAE of each cell and of everything (variable and horizon null)."""
    return records.groupingSets([CELL, []], *CELL).agg(F.sqrt(F.avg(F.col("raw_error") * F.col("raw_error"))).alias("rmse"), F.avg(F.abs("raw_error")).alias("mae"), F.count(F.lit(1)).alias("n")).select(*CELL, "rmse", "mae", "n")


def equal_variable_rmse(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    each = records.groupBy(*by, "variable").agg(F.avg(F.col("raw_error") * F.col("raw_error")).alias("mse"))
    return each.groupBy(*by).agg(F.sqrt(F.avg("mse")).alias("rmse"), F.count(F.lit(1)).alias("n_variables"))


def attach_benchmark(records: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark forecasts by (origin, variable, horizon); the error is realization less forecast."""
    return records.join(benchmark.select("origin", *CELL, F.col("forecast").alias("benchmark_forecast")), ["origin", *CELL], "left").withColumn("benchmark_error", F.col("realization") - F.col("benchmark_forecast"))
