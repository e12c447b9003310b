"""Loss tables, ranks, gains, stability and failure summaries of forecast panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import failure_class
from ..schemas import CELL, DataError
from .pairing import common_sample, paired, percent_change

TAGS = ["model", "family", "size", "scope", "selection", "forecast_method"]
SCOPES = ["pooled", "horizon", "variable", "variable_horizon", "native"]
GAINS = ["horizon_gain", "variable_gain", "interaction_gain", "vh_vs_pooled", "pooled_vs_native"]


def loss(kind: str, error: Column) -> Column:
    """Null errors are skipped in the value; callers count rows apart."""
    return {"rmse": F.sqrt(F.avg(error * error)), "mse": F.avg(error * error), "mae": F.avg(F.abs(error))}[kind]


def loss_by_target(panel: DataFrame, kind: str = "rmse", policy: str = "restrict", min_coverage: float = 0.0) -> DataFrame:
    """Loss of each model and cell on the common sample, with rows used, in total and excluded."""
    total = panel.groupBy("model", *CELL).agg(F.count(F.lit(1)).alias("n_total"))
    kept = common_sample(panel, policy=policy, min_coverage=min_coverage).groupBy("model", *CELL).agg(loss(kind, F.col("error")).alias(kind), F.count(F.lit(1)).alias("n"))
    return kept.join(total, ["model", *CELL]).select("model", *CELL, kind, "n", "n_total", (F.col("n_total") - F.col("n")).alias("n_excluded"))


def cell_losses(panel: DataFrame, kind: str = "mse", policy: str = "restrict") -> DataFrame:
    """Loss by all tags and cell; null tags are groups of their own."""
    return common_sample(panel, policy=policy).groupBy(*TAGS, *CELL).agg(loss(kind, F.col("error")).alias("loss"), F.count(F.lit(1)).alias("n"))


def relative_rmse(table: DataFrame, baseline: str) -> DataFrame:
    """Ratio and percent change against the baseline's row of the same cell."""
    base = table.filter(F.col("model") == baseline).select(*CELL, F.col("rmse").alias("baseline_rmse"))
    return table.join(base, CELL, "left").select("model", *CELL, "rmse", "baseline_rmse", F.when(F.col("baseline_rmse") > 0, F.col("rmse") / F.col("baseline_rmse")).alias("relative"), percent_change(F.col("rmse"), F.col("baseline_rmse")).alias("percent"))


def relative_rmse_pairwise(panel: DataFrame, baseline: str) -> DataFrame:
    """As above, each model on the sample it shares with the baseline alone."""
    rows = paired(panel, baseline).filter("status = 'common'")
    out = rows.groupBy("model", *CELL).agg(F.count(F.lit(1)).alias("n"), loss("rmse", F.col("error")).alias("rmse"), loss("rmse", F.col("base_error")).alias("baseline_rmse"))
    return out.withColumn("relative", F.when(F.col("baseline_rmse") > 0, F.col("rmse") / F.col("baseline_rmse"))).withColumn("sample_basis", F.lit("pairwise"))


def average_ranks(table: DataFrame, require_common: bool = True) -> DataFrame:
    """Mean over cells of the rank by RMSE, ties sharing their mean rank."""
    if require_common and "n" in table.columns:
        mixed = table.groupBy(*CELL).agg(F.countDistinct("n").alias("k")).filter("k > 1").limit(1).collect()
        if mixed:
            raise DataError(f"cell with mixed samples: {mixed[0].asDict()}")
    cell = Window.partitionBy(*CELL)
    ranked = table.filter("rmse is not null").withColumn("rank", F.rank().over(cell.orderBy("rmse")) + (F.count(F.lit(1)).over(Window.partitionBy(*CELL, "rmse")) - 1) / 2)
    return ranked.groupBy("model").agg(F.avg("rank").alias("average_rank"), F.count(F.lit(1)).alias("n_cells"))


def scope_gains(panel: DataFrame, kind: str = "rmse") -> DataFrame:
    """Losses by scope and the gains between them, for each system and cell; the sample is common inside a system."""
    system = ["family", "size", "forecast_method"]
    sized = panel.withColumn("size", F.coalesce("size", F.lit("~")))
    kept = common_sample(sized, by=system + CELL)
    losses = [loss(kind, F.when(F.col("scope") == s, F.col("error"))).alias("loss_" + s) for s in SCOPES]
    return kept.groupBy(*system, *CELL).agg(*losses).withColumn("size", F.nullif(F.col("size"), F.lit("~")))


def with_gains(losses: DataFrame) -> DataFrame:
    c = lambda s: F.col("loss_" + s)
    return losses.select(
        "*", (c("pooled") - c("horizon")).alias("horizon_gain"), (c("pooled") - c("variable")).alias("variable_gain"), (F.least(c("horizon"), c("variable")) - c("variable_horizon")).alias("interaction_gain"),
        (c("pooled") - c("variable_horizon")).alias("vh_vs_pooled"), (c("native") - c("pooled")).alias("pooled_vs_native"),
    )


def gain_summary(gains: DataFrame) -> DataFrame:
    long = gains.select(*[F.col(g) for g in GAINS]).unpivot([], GAINS, "gain", "value").filter("value is not null")
    return long.groupBy("gain").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.least(F.min("value"), F.lit(0.0)).alias("worst"), F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("share_positive"))


def parameter_summary(selected: DataFrame, parameters: list[str]) -> DataFrame:
    """Mean, deviation (0 for one value), extremes and number of each model's chosen parameters."""
    long = selected.select("model", *[F.col(p).cast("double").alias(p) for p in parameters]).unpivot(["model"], parameters, "parameter", "value").filter("value is not null")
    return long.groupBy("model", "parameter").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def selection_stability(selected: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Origins, distinct values, share of the most frequent value and changes from one origin to the next."""
    step = selected.withColumn("_switch", (F.col(value) != F.lag(value).over(Window.partitionBy(*by).orderBy(order))).cast("int"))
    runs = step.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"), F.sum("_switch").alias("s"))
    return runs.groupBy(*by).agg(F.sum("c").alias("n_origins"), F.count(F.lit(1)).alias("n_unique"), (F.max("c") / F.sum("c")).alias("modal_fraction"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_switches"))


def failure_summary(failures: DataFrame) -> DataFrame:
    """Counts by model and stage, and each model's total."""
    staged = failures.withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    return staged.groupingSets([["model", "stage"], ["model"]], "model", "stage").agg(F.count(F.lit(1)).alias("n_failures"), F.grouping("stage").alias("_all")).select("model", F.when(F.col("_all") == 1, "__total__").otherwise(F.col("stage")).alias("stage"), "n_failures")


def failures_by_category(failures: DataFrame, text: str = "error") -> DataFrame:
    return failures.groupBy("stage", failure_class(F.col(text)).alias("category")).agg(F.count(F.lit(1)).alias("n_failures"))


def computational_cost(metadata: DataFrame, json: str, fields: dict[str, list[str]]) -> DataFrame:
    """One column for each cost; the first alias that the JSON has counts."""
    value = lambda names: F.coalesce(*[F.get_json_object(F.col(json), f"$.{n}") for n in names])
    return metadata.select("model", *[F.expr("null").cast("double").alias(k) if not names else value(names).try_cast("double").alias(k) for k, names in fields.items()])


def unpaired_rmse(panel: DataFrame) -> DataFrame:
    """RMSE of each model and cell on its own rows, whatever the others have: not comparable between models."""
    return panel.filter("error is not null").groupBy("model", "variable", "horizon").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def variants(panel: DataFrame, horizon: str = "optimization_horizon") -> DataFrame:
    """``panel`` with models of several horizons of optimisation kept apart by name."""
    return panel.withColumn("model", F.when(F.col(horizon).isNull(), F.col("model")).otherwise(F.concat_ws("/", "model", horizon)))


def ordered_models(panel: DataFrame, known: list[str]) -> DataFrame:
    """Distinct models, known ones first in their order, then by name."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col("model"))
    return panel.select("model").distinct().withColumn("position", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(len(known) + 1), "model")))
