"""All tables of a comparison, their overview and their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inference, metrics, pairing
from ..sources import panels


def comparison(panel: DataFrame, baseline: str, selected: DataFrame | None = None, parameters: list[str] | None = None, failures: DataFrame | None = None, draws: int = 500) -> dict[str, DataFrame]:
    """Lazy tables over one canonical panel, restricted once to the common sample where they need it.

    Everything but the alignment, the paired scores and the pairwise ratios is
    on the common sample of each cell; gains are on that of their system.
    """
    common = pairing.common_sample(panel)
    rmse = metrics.loss_by_target(panel)
    gains = metrics.with_gains(metrics.scope_gains(panel))
    pairs = pairing.paired_errors(common, pairing.scope_contrasts(common))
    tables = {
        "alignment": pairing.origin_alignment(panel),
        "common_sample": pairing.sample_report(panel),
        "rmse": rmse,
        "mae": metrics.loss_by_target(panel, "mae"),
        "relative_rmse": metrics.relative_rmse(rmse, baseline),
        "relative_rmse_pairwise": metrics.relative_rmse_pairwise(panel, baseline),
        "paired_scores": pairing.paired_scores(panel, baseline),
        "average_ranks": metrics.average_ranks(rmse, require_common=False),  # restricted above
        "scope_gains": gains,
        "scope_gain_summary": metrics.gain_summary(gains),
        "dm_tests": inference.dm_tests(pairs),
        "bootstrap_intervals": inference.bootstrap_intervals(pairs, draws=draws),
    }
    if selected is not None and parameters:
        tables["parameters"] = metrics.parameter_summary(selected, parameters)
    if failures is not None:
        tables["failures"] = metrics.failure_summary(failures)
    return tables


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    counts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def write(tables: dict[str, DataFrame], folder: str, layout: str = "csv") -> None:
    """One table a folder; a report's tables have a row for each model, cell or contrast."""
    for name, t in tables.items():
        panels.write_table(t.coalesce(1), f"{folder}/{name}", layout)


def markdown(tables: dict[str, DataFrame], names: list[str] | None = None) -> str:
    return "\n".join(panels.markdown(tables[n], n) for n in names or ["alignment", "average_ranks", "scope_gain_summary"])
