"""Common samples and pairings of forecast panels.

``panel`` is canonical: a row for each model and observation key inside a cell
(variable, horizon). Keys may hold nulls; they pair null with null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CELL, OBSERVATION, DataError


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def tagged(panel: DataFrame, **criteria) -> DataFrame:
    """Rows that meet all criteria: equal to a value, among a list, or null for None."""
    for name, value in criteria.items():
        column = F.col(name)
        panel = panel.filter(column.isNull() if value is None else column.isin(list(value)) if isinstance(value, (list, tuple, set)) else column == value)
    return panel


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by name whose null keys pair; each key once, as in a join by name.

    The sides' key columns get names of their own first, so sides of one origin stay apart.
    """
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    # In a full join a row of the right side alone has its keys there; a key that is null on the left of a pair is null on the right too.
    key = (lambda k: F.coalesce(F.col(k), F.col(f"_right_{k}")).alias(k)) if how in ("full", "right") else F.col
    return joined.select(*[key(k) for k in keys], *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])


def shared_keys(panel: DataFrame, by: list[str] = CELL, key: list[str] = OBSERVATION, member: str = "model") -> DataFrame:
    """Keys that every member of their cell has (relational division inside each cell)."""
    present = panel.select(*by, *key, member).distinct()
    per_key = present.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("_have"))
    per_cell = present.select(*by, member).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    joined = per_key.join(per_cell, null_safe(per_key, per_cell, by))
    return joined.filter("_have = _all").select(*[per_key[c] for c in by + key])


def common_sample(panel: DataFrame, models: list[str] | None = None, by: list[str] = CELL, policy: str = "restrict", min_coverage: float = 0.0) -> DataFrame:
    """Rows whose key all models of the cell have.

    ``policy``: ``restrict`` drops the others, ``raise`` refuses if there are
    any, ``advisory`` returns the panel as it is. Under ``restrict`` a model and
    cell with less than ``min_coverage`` of its rows left is refused.
    """
    panel = panel.filter(F.col("model").isin(models)) if models else panel
    if policy == "advisory":
        return panel
    keys = shared_keys(panel, by)
    kept = panel.join(keys, null_safe(panel, keys, by + OBSERVATION), "left_semi")
    if policy == "raise" and panel.count() != kept.count():
        raise DataError("models do not share one sample")
    if min_coverage > 0:
        low = sample_report(panel, by).filter(F.col("coverage") < min_coverage).limit(1).collect()
        if low:
            raise DataError(f"coverage too low: {low[0].asDict()}")
    return kept


def sample_report(panel: DataFrame, by: list[str] = CELL) -> DataFrame:
    """For each model and cell: rows, rows on the common sample, keys common and excluded, coverage."""
    marked = null_safe_join(panel, shared_keys(panel, by).withColumn("_common", F.lit(True)), by + OBSERVATION, "left")
    counts = marked.groupBy("model", *by).agg(F.count(F.lit(1)).alias("n_rows"), F.count("_common").alias("n_common_rows"))
    keys = marked.groupBy(*by).agg(F.countDistinct(F.when(F.col("_common"), F.struct(*OBSERVATION))).alias("n_common_keys"), F.countDistinct(F.struct(*OBSERVATION)).alias("_keys"))
    return null_safe_join(counts, keys, by).select("model", *by, "n_rows", "n_common_rows", "n_common_keys", (F.col("_keys") - F.col("n_common_keys")).alias("n_excluded_keys"), (F.col("n_common_rows") / F.col("n_rows")).alias("coverage"))


def sample_totals(panel: DataFrame, by: list[str] = CELL) -> DataFrame:
    """Over all cells: rows in and on the common sample, keys common and excluded, coverage; a row for each model, and ``__all__``."""
    report = sample_report(panel, by)
    rows = lambda c: F.sum(c).alias(c)
    models = report.groupBy("model").agg(rows("n_rows"), rows("n_common_rows"), rows("n_common_keys"), rows("n_excluded_keys"))
    cells = report.select(*by, "n_common_keys", "n_excluded_keys").distinct().agg(rows("n_common_keys"), rows("n_excluded_keys"))
    every = report.agg(rows("n_rows"), rows("n_common_rows")).crossJoin(F.broadcast(cells)).select(F.lit("__all__").alias("model"), "n_rows", "n_common_rows", "n_common_keys", "n_excluded_keys")  # one row each
    return models.unionByName(every).withColumn("coverage", F.try_divide(F.col("n_common_rows"), F.col("n_rows")))


def paired(panel: DataFrame, baseline: str, by: list[str] = CELL) -> DataFrame:
    """Full outer pairing of every model with the baseline on the observation key, with a status for each row.

    The status is the first that fits: missing_model_key, missing_baseline_key,
    missing_model_error, missing_baseline_error, actual_mismatch, common.
    """
    keys = by + OBSERVATION
    base = panel.filter(F.col("model") == baseline).select(*keys, F.col("error").alias("base_error"), F.col("actual").alias("base_actual"))
    cells = panel.select("model", *by).distinct()
    grid = null_safe_join(base, cells, by).withColumn("_base", F.lit(True))
    mine = panel.select("model", *keys, "error", "actual").withColumn("_mine", F.lit(True))
    both = null_safe_join(mine, grid, ["model", *keys], "full")
    status = (
        F.when(F.col("_mine").isNull(), "missing_model_key")
        .when(F.col("_base").isNull(), "missing_baseline_key")
        .when(F.col("error").isNull(), "missing_model_error")
        .when(F.col("base_error").isNull(), "missing_baseline_error")
        .when(F.abs(F.col("actual") - F.col("base_actual")) > 1e-6, "actual_mismatch")
        .otherwise("common")
    )
    return both.withColumn("status", status).drop("_mine", "_base")


def paired_scores(panel: DataFrame, baseline: str, by: list[str] = CELL, min_coverage: float = 0.0) -> DataFrame:
    """RMSE of each model and of the baseline on their common rows, counts, coverage and percent change."""
    rows = paired(panel, baseline, by)
    common = F.col("status") == "common"
    rmse = lambda e: F.sqrt(F.avg(F.when(common, F.col(e) * F.col(e))))
    out = rows.groupBy("model", *by).agg(
        rmse("error").alias("rmse"), rmse("base_error").alias("baseline_rmse"),
        F.count_if(F.col("error").isNotNull()).alias("n_model"), F.count_if(F.col("base_error").isNotNull()).alias("n_baseline"), F.count_if(common).alias("n_common"),
        F.count_if(F.col("error").isNotNull() & ~common).alias("excluded_model"), F.count_if(F.col("base_error").isNotNull() & ~common).alias("excluded_baseline"),
    )
    out = out.withColumn("common_coverage", F.try_divide(F.col("n_common"), F.greatest("n_model", "n_baseline"))).withColumn("percent_change", percent_change(F.col("rmse"), F.col("baseline_rmse")))
    if min_coverage > 0:
        low = out.filter(F.col("common_coverage") < min_coverage).limit(1).collect()
        if low:
            raise DataError(f"coverage too low: {low[0].asDict()}")
    return out


def percent_change(value: Column, base: Column) -> Column:
    return F.when(base > 0, 100 * (value - base) / base)


def exclusions(panel: DataFrame, baseline: str, by: list[str] = CELL) -> DataFrame:
    return paired(panel, baseline, by).filter("status <> 'common'")


def audit(panel: DataFrame, baseline: str, failures: DataFrame, by: list[str] = CELL) -> DataFrame:
    """The exclusions and, below them, the origins at which a run failed (model, forecast_origin, stage, error), status ``run_failure``."""
    return exclusions(panel, baseline, by).unionByName(failures.withColumn("status", F.lit("run_failure")), allowMissingColumns=True)


def paired_errors(panel: DataFrame, contrasts: DataFrame, by: list[str] = CELL) -> DataFrame:
    """All contrasts (contrast, model_a, model_b) and cells in one self-join: both errors of each shared key."""
    keys = by + OBSERVATION
    a = panel.select(F.col("model").alias("model_a"), *keys, "origin_ord", F.col("error").alias("error_a"))
    b = panel.select(F.col("model").alias("model_b"), *keys, F.col("error").alias("error_b"))
    # The contrasts' number is the square of the models' at most and independent of the panel's rows; Spark chooses by its size.
    return null_safe_join(a.join(contrasts, "model_a"), b, ["model_b", *keys])


def origin_alignment(panel: DataFrame) -> DataFrame:
    """For each model: its origins, those that all models have, and those that not all have."""
    origins = panel.select("model", "forecast_origin").distinct()
    shared = origins.groupBy("forecast_origin").agg(F.count(F.lit(1)).alias("_have"))
    total = panel.select("model").distinct().agg(F.count(F.lit(1)).alias("_all"))
    marked = origins.join(shared, "forecast_origin").join(F.broadcast(total))  # one row
    common = F.count_if(F.col("_have") == F.col("_all"))
    return marked.groupBy("model").agg(F.count(F.lit(1)).alias("n_origins"), common.alias("n_common"), (F.count(F.lit(1)) - common).alias("n_unmatched"))


def scope_contrasts(panel: DataFrame) -> DataFrame:
    """Pairs of scopes inside one system, and of forecast methods inside one scope; null tags match each other."""
    tags = panel.groupBy("family", "size", "forecast_method", "scope").agg(F.min("model").alias("model"))
    a = tags.select(*[F.col(c).alias("a_" + c) for c in tags.columns])
    b = tags.select(*[F.col(c).alias("b_" + c) for c in tags.columns])
    same = lambda *cs: reduce(lambda x, y: x & y, [F.col("a_" + c).eqNullSafe(F.col("b_" + c)) for c in cs])
    # The scope pairs that are compared.
    pairs = [("horizon", "pooled"), ("variable", "pooled"), ("variable_horizon", "pooled"), ("variable_horizon", "horizon"), ("variable_horizon", "variable"), ("pooled", "native")]
    wanted = reduce(lambda x, y: x | y, [(F.col("a_scope") == p) & (F.col("b_scope") == q) for p, q in pairs])
    scopes = a.join(b, same("family", "size", "forecast_method") & wanted)
    methods = a.join(b, same("family", "size", "scope") & (F.col("a_forecast_method") == "direct") & (F.col("b_forecast_method") == "iterated"))
    made = scopes.withColumn("kind", F.lit("scope")).unionByName(methods.withColumn("kind", F.lit("method")))
    return made.select("kind", F.col("a_model").alias("model_a"), F.col("b_model").alias("model_b"), F.concat_ws(" vs ", "a_model", "b_model").alias("contrast"))
