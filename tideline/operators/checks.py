"""Contract checks. Each gives a DataFrame of findings; ``enforce`` turns findings into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DataError


def enforce(findings: DataFrame, what: str, show: int = 5) -> None:
    """Raise with the first few findings, if there is one; looks at no more."""
    rows = findings.limit(show).collect()
    if rows:
        raise DataError(f"{what}: {[r.asDict() for r in rows]}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def inconsistent_actuals(panel: DataFrame, keys: list[str], actual: str = "actual", tolerance: float = 1e-6) -> DataFrame:
    return panel.groupBy(*keys).agg(F.min(actual).alias("least"), F.max(actual).alias("greatest"), F.count(F.lit(1)).alias("n")).filter(F.col("greatest") - F.col("least") > tolerance)


def vintage_violations(panel: DataFrame) -> DataFrame:
    """For each series: rows, missing core values, observations after their vintage, repeated keys."""
    keys = panel.groupBy("series_id", "vintage_date", "observation_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"),
    )
    return keys.groupBy("series_id").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("vintage_date").isNull() | F.col("observation_date").isNull(), F.col("n")).otherwise(F.col("nulls"))).alias("n_missing"),
        F.sum(F.when(F.col("observation_date") > F.col("vintage_date"), F.col("n")).otherwise(0)).alias("n_future"),
        F.sum(F.col("n") - 1).alias("n_repeated"),
    )


def provenance_violations(panel: DataFrame) -> DataFrame:
    """Vintages with rows from a fallback, or whose rows don't name one hash: (series_id, vintage_date, n_rows, n_fallback, n_hashes)."""
    found = panel.groupBy("series_id", "vintage_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.lower(F.col("fallback_used").cast("string")).isin("true", "1")).alias("n_fallback"), F.countDistinct("data_sha256").alias("n_hashes"))
    return found.filter("n_fallback > 0 or n_hashes <> 1")


def content_hash(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """An order-free fingerprint of each group's rows: their number and the sum of 60-bit prefixes of the rows' SHA-256."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias("content_sum"))


def conflicting_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields with more than one distinct non-null value."""
    return df.agg(*[F.countDistinct(f).alias(f) for f in fields]).unpivot([], fields, "field", "n_values").filter("n_values > 1")


def compatible_metadata(df: DataFrame, fields: dict[str, list[str]], label: str = "model", allow_missing: bool = False) -> DataFrame:
    """Fields of run metadata that don't agree, or that a run lacks: (field, n_values, missing).

    ``fields``: the names under which each field may stand; the first that a
    run has counts. A missing field is a finding unless ``allow_missing``.
    """
    found = {f: F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in df.columns], F.lit(None).cast("string")) for f, names in fields.items()}
    long = df.select(F.col(label).alias("_label"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in found.items()])).alias("e")).select("_label", "e.*")
    out = long.groupBy("field").agg(F.countDistinct("value").alias("n_values"), F.sort_array(F.collect_set(F.when(F.col("value").isNull(), F.col("_label")))).alias("missing"))  # labels of runs
    bad = F.col("n_values") > 1
    return out.filter(bad if allow_missing else bad | (F.size("missing") > 0))


def information_lag(df: DataFrame, origin_quarter: Column, last_quarter: Column, expected: int) -> DataFrame:
    return df.withColumn("lag_quarters", origin_quarter - last_quarter).withColumn("as_expected", F.col("lag_quarters") == expected)


def partition_faults(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that no cell or more than one cell holds, and cells' targets that were not asked for."""
    held = plan.groupBy("variable", "horizon").agg(F.count(F.lit(1)).alias("n_cells"))
    return targets.withColumn("asked", F.lit(True)).join(held, ["variable", "horizon"], "full").select("variable", "horizon", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("asked", F.lit(False)).alias("asked")).filter("n_cells <> 1 or not asked")


def leaking_splits(splits: DataFrame) -> DataFrame:
    """Splits whose training end passes the origin, or whose targets don't lie after it or pass the cutoff."""
    last = F.array_max(F.map_values("targets"))
    first = F.array_min(F.map_values("targets"))
    return splits.filter((F.col("train_end") > F.col("origin")) | (F.col("train_start") > F.col("train_end")) | (first <= F.col("origin")) | (last > F.col("info_cutoff")))
