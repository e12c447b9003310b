"""Forecast comparison tests: HAC variance, Diebold-Mariano, bootstrap intervals, Holm."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import child_seed
from ..functions.special import t_two_sided
from ..shipping import ship


def loss_differentials(pairs: DataFrame, kind: str = "squared") -> DataFrame:
    """Loss of a less loss of b; positive where b is better."""
    f = (lambda e: e * e) if kind == "squared" else F.abs
    return pairs.withColumn("d", f(F.col("error_a")) - f(F.col("error_b")))


def _with_terms(series: DataFrame, by: list[str], order: list[str], most: int, fixed: bool, kernel: str, value: str) -> DataFrame:
    """Rows with their number ``_n``, lags ``_lag`` and the part ``_term`` that each adds to its group's long-run variance."""
    group = Window.partitionBy(*by)
    placed = group.orderBy(*order)
    rows = series.withColumn("_c", F.col(value) - F.avg(value).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    rows = rows.withColumn("_lag", F.least(F.lit(most) if fixed else F.col("max_lag"), F.col("_n") - 1))
    term = F.col("_c") * F.col("_c")
    for k in range(1, most + 1):
        weight = 2.0 * ((1 - F.lit(float(k)) / (F.col("_lag") + 1)) if kernel == "bartlett" else F.lit(1.0))
        term = term + F.when(F.col("_lag") >= k, F.coalesce(F.col("_c") * F.lag("_c", k).over(placed), F.lit(0.0)) * weight).otherwise(0.0)
    return rows.withColumn("_term", term / F.col("_n"))


def long_run_variance(series: DataFrame, by: list[str], order: list[str], lags: int | None, kernel: str = "bartlett", value: str = "d", longest: int | None = None) -> DataFrame:
    """gamma_0 + 2 sum w_k gamma_k, every gamma divided by n; at most n - 1 lags.

    ``lags``: a number, or None where the column ``max_lag`` has it; ``longest``
    is its maximum, looked up where it isn't given. All lags are read in one
    window over each group, so the rows are shuffled once.
    """
    if lags is None and longest is None:
        longest = series.agg(F.max("max_lag")).first()[0] or 0
    rows = _with_terms(series, by, order, int(longest if lags is None else lags), lags is not None, kernel, value)
    return rows.groupBy(*by).agg(F.sum("_term").alias("long_run_variance"), F.first("_n").alias("n"), F.first("_lag").alias("lag"))


def dm_statistics(pairs: DataFrame, kind: str = "squared", longest: int | None = None) -> DataFrame:
    """Statistic, small-sample factor and validity for each contrast and cell; pairs with a null error make it invalid.

    ``longest``: the longest horizon, where it is known. Variances, means and
    counts come from one deal of the rows and one aggregate; null differentials
    have windows of their own, so the variance is that of the known ones.
    """
    by = ["contrast", "variable", "horizon"]
    rows = loss_differentials(pairs, kind)
    if longest is None:
        longest = rows.agg(F.max("horizon")).first()[0] or 1
    rows = rows.repartition(*by).withColumn("_gap", F.col("d").isNull()).withColumn("max_lag", F.col("horizon") - 1)
    rows = _with_terms(rows, [*by, "_gap"], ["origin_ord", "target", "group"], int(longest) - 1, False, "bartlett", "d")
    known = lambda c: F.when(~F.col("_gap"), F.col(c))
    joined = rows.groupBy(*by).agg(
        F.avg("d").alias("mean_differential"), F.count(F.lit(1)).alias("n_pairs"), F.count_if("_gap").alias("n_null"),
        F.sum(known("_term")).alias("long_run_variance"), F.max(known("_n")).alias("n"), F.max(known("_lag")).alias("lag"),
    )
    n, h = F.col("n").cast("double"), F.col("horizon").cast("double")
    factor = (n + 1 - 2 * h + h * (h - 1) / n) / n
    reason = (
        F.when(F.col("n_null") > 0, "missing errors")
        .when(F.col("n").isNull() | (F.col("n") < F.greatest(F.lit(8), F.col("horizon") + 1)), "too small a sample")
        .when(F.col("long_run_variance") <= 1e-12, "zero variance")
        .when(F.col("factor") <= 0, "no small-sample factor")
    )
    joined = joined.withColumn("factor", F.when(F.col("n") > 0, factor)).withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    statistic = F.when(F.col("valid"), F.col("mean_differential") / F.sqrt(F.when(F.col("valid"), F.col("long_run_variance") / n)) * F.sqrt(F.when(F.col("valid"), F.col("factor"))))
    return joined.withColumn("statistic", statistic).select(*by, "n_pairs", "mean_differential", "long_run_variance", "lag", "statistic", "valid", "reason")


def dm_tests(pairs: DataFrame, kind: str = "squared", longest: int | None = None) -> DataFrame:
    """As above with p values (Student's t, n - 1) and Holm's adjustment inside each contrast."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        good = t.notna()
        out = pd.Series(np.nan, index=t.index, dtype=object)
        out[good] = t_two_sided(t[good].astype(float), n[good].astype(float) - 1)
        return out.where(good, None)

    return holm(dm_statistics(pairs, kind, longest).withColumn("p_value", p_value("statistic", "n_pairs")), ["contrast"])


def holm(tests: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """Step-down: running maximum of min(1, (m - rank + 1) p) over the known p values of a family."""
    family = Window.partitionBy(*by)
    known = F.col(p).isNotNull() & ~F.isnan(p)
    order = family.orderBy(F.col("_known").desc(), p, *[c for c in ("variable", "horizon") if c in tests.columns])
    step = F.least(F.lit(1.0), (F.count_if("_known").over(family) - F.row_number().over(order) + 1) * F.col(p))
    marked = tests.withColumn("_known", known).withColumn("_s", F.when(F.col("_known"), step))
    highest = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("p_holm", F.when(F.col("_known"), highest)).drop("_known", "_s")


def bootstrap_means(d: np.ndarray, method: str, block: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Means of resampled series: moving blocks, or the stationary bootstrap on the circle."""
    n = len(d)
    if method == "moving":
        block = min(block, n)
        starts = rng.integers(0, n - block + 1, (draws, -(-n // block)))
        places = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]
    else:
        fresh = rng.random((draws, n)) < 1 / block
        fresh[:, 0] = True
        jump = rng.integers(0, n, (draws, n))
        last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0), axis=1)
        places = (np.take_along_axis(jump, last, axis=1) + np.arange(n) - last) % n
    return d[places].mean(axis=1)


def bootstrap_intervals(pairs: DataFrame, method: str = "moving", draws: int = 999, level: float = 0.95, seed: int = 0, kind: str = "squared") -> DataFrame:
    """Percentile interval of the mean differential for each contrast and cell; fewer than two pairs make an invalid row."""
    ship(pairs.sparkSession)
    schema = "contrast string, variable string, horizon int, n int, mean_differential double, low double, high double, valid boolean"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin_ord", "target", "group"])
        d = rows["d"].dropna().to_numpy(float)
        n, h = len(d), int(key[2])
        if n < 2 or n < len(rows):
            return pd.DataFrame([[*key, n, d.mean() if n else None, None, None, False]], columns=[c.split()[0] for c in schema.split(", ")])
        rng = np.random.Generator(np.random.PCG64(child_seed(seed, *key)))
        means = bootstrap_means(d, method, max(h, round(n ** (1 / 3))), draws, rng)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([[*key, n, d.mean(), low, high, True]], columns=[c.split()[0] for c in schema.split(", ")])

    rows = loss_differentials(pairs, kind).select("contrast", "variable", F.col("horizon").cast("int").alias("horizon"), "origin_ord", "target", "group", "d")
    return rows.groupBy("contrast", "variable", "horizon").applyInPandas(one, schema)
