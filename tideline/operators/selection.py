"""Arg-min with ties, and choices of lags and origins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_candidate(losses: DataFrame, by: list[str], tolerance: float = 0.0) -> DataFrame:
    """The candidate of least finite loss; within ``tolerance`` the simplest one.

    Simpler: fewer lags, more shrinkage, fewer distinctions between own and
    cross lags, a smaller decay, a cross multiplier nearer to 1, then smaller.
    Candidates: lam, p, alpha, kappa, loss. ``n_tied`` counts those within the
    tolerance. Candidates without a finite loss are left out.
    """
    finite = losses.filter(F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < float("inf")))
    least = finite.withColumn("_least", F.min("loss").over(Window.partitionBy(*by)) if by else F.min("loss").over(Window.partitionBy(F.lit(0))))
    near = least.filter(F.col("loss") <= F.col("_least") + tolerance)
    distinct = (F.col("alpha") != 0).cast("int") + (F.col("kappa") != 1).cast("int")
    order = F.struct(F.col("p"), -F.col("lam"), distinct, F.col("alpha"), F.abs(F.col("kappa") - 1), F.col("kappa"))
    return near.groupBy(*by).agg(F.min_by(F.struct("lam", "p", "alpha", "kappa", "loss"), order).alias("b"), F.count(F.lit(1)).alias("n_tied")).select(*by, "b.*", "n_tied")


def first_best(losses: DataFrame, by: list[str], order: str) -> DataFrame:
    """Least score, the first in ``order`` among equals."""
    return losses.groupBy(*by).agg(F.min_by(order, F.struct("loss", order)).alias(order), F.min("loss").alias("loss"))


def choose_lag(criteria: DataFrame, by: list[str], criterion: str) -> DataFrame:
    """The lag of least criterion, the shorter on ties; 1 where no criterion is known."""
    return criteria.groupBy(*by).agg(F.coalesce(F.min_by("p", F.when(F.col(criterion).isNotNull(), F.struct(criterion, "p"))), F.lit(1)).alias("p"))


def pick_origins(origins: DataFrame, n: int, how: str = "most_recent", by: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``n`` of the origins (column ``origin``): the last, evenly spaced ones, or a seeded draw."""
    by = by or []
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(part.orderBy("origin")) - 1
    if how == "most_recent":
        return origins.withColumn("_r", F.row_number().over(part.orderBy(F.desc("origin")))).filter(F.col("_r") <= n).drop("_r")
    ranked = origins.withColumn("_i", rank).withColumn("_n", F.count(F.lit(1)).over(part))
    if how == "evenly_spaced":  # half to even; a single one is the first
        places = F.array(*[F.lit(0) if n == 1 else F.bround(F.lit(i) * (F.col("_n") - 1) / F.lit(float(n - 1))).cast("int") for i in range(n)])
        return ranked.withColumn("_p", places).filter(F.col("_n") >= n).filter(F.array_contains("_p", F.col("_i"))).drop("_i", "_n", "_p")
    if how == "random":
        total = origins.count()
        chosen = sorted(np.random.Generator(np.random.PCG64(seed)).choice(total, n, replace=False).tolist())
        return ranked.filter(F.col("_i").isin(chosen)).drop("_i", "_n")
    raise ValueError(how)
