"""Paths of posterior draws in long form: (draw, variable, period, value, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vintage


def stacked(segments: list[tuple[str, DataFrame]], draws: DataFrame | None = None) -> DataFrame:
    """One path for each draw from named segments, the first segment that has a period counting.

    A segment without a ``draw`` column (history, the same in every path) is
    repeated for each row of ``draws``; a key that a segment holds twice is an
    error of the caller and stays twice.
    """
    parts = []
    for place, (name, rows) in enumerate(segments):
        if "draw" not in rows.columns:
            rows = rows.join(F.broadcast(draws.select("draw").distinct()))  # the numbers of the draws, a parameter
        parts.append(rows.select("draw", "variable", "period", "value", F.lit(name).alias("segment"), F.lit(place).alias("_place")))
    whole = reduce(DataFrame.unionByName, parts)
    first = F.min("_place").over(Window.partitionBy("draw", "variable", "period"))
    return whole.withColumn("_first", first).filter("_place = _first").drop("_place", "_first")


def path_growth(paths: DataFrame, variables: list[str]) -> DataFrame:
    """``metric``: growth inside each path for ``variables`` (null in its first period), the level for the others.

    A level of a growth variable that isn't positive is an error.
    """
    grows = F.col("variable").isin(variables)
    level = F.when(F.col("value") <= 0, F.raise_error(F.concat(F.lit("growth needs positive levels of "), F.col("variable"))).cast("double")).otherwise(F.col("value"))
    step = 100 * (F.ln(level) - F.lag(F.ln(level)).over(Window.partitionBy("draw", "variable").orderBy("period")))
    return paths.withColumn("metric", F.when(grows, step).otherwise(F.col("value")))


def path_summaries(paths: DataFrame, growth: list[str]) -> DataFrame:
    """Mean and quantiles over the draws, of levels and of the metric, for each variable and period."""
    long = path_growth(paths, growth).select("variable", "period", F.explode(F.array(F.struct(F.lit("level").alias("kind"), F.col("value").alias("x")), F.struct(F.lit("metric").alias("kind"), F.col("metric").alias("x")))).alias("e"))
    return vintage.summaries(long.select("variable", "period", "e.kind", F.col("e.x").alias("value")), ["variable", "period", "kind"])


def scoring_frame(panel: DataFrame, at, growth: list[str]) -> DataFrame:
    """Actual values to score against, from one fixed later vintage: (series_id, period, value, metric); periods that no series has are dropped."""
    known = vintage.at_vintage(panel, at).filter("value is not null")
    step = 100 * (F.ln("value") - F.lag(F.ln("value")).over(Window.partitionBy("series_id").orderBy("period")))
    return known.select("series_id", "period", "value", F.when(F.col("series_id").isin(growth), step).otherwise(F.col("value")).alias("metric"))
