"""A read-through cache of tables with their provenance, in any store that Spark writes to."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.tables import literal_table
from ..operators.checks import content_hash
from ..schemas import DataError


def _fingerprint(df: DataFrame) -> tuple[int, str]:
    r = content_hash(df.withColumn("_all", F.lit(1)), sorted(df.columns), ["_all"]).first()
    return (r.n_rows, r.content_sum) if r else (0, "")


def _held(spark: SparkSession, path: str) -> dict | None:
    try:
        row = spark.read.parquet(f"{path}/provenance").first()
    except AnalysisException:
        return None
    return row.asDict() if row else None


def read_through(spark: SparkSession, path: str, source: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The cached table of ``source`` at ``path``, built and written where it isn't there.

    A sidecar holds the source's name, the time, the row count and a content
    hash. A cache of another source, or one whose rows no longer give the hash,
    is an error and never silently used.
    """
    held = None if refresh else _held(spark, path)
    if held is None:
        build().write.mode("overwrite").parquet(f"{path}/data")
        df = spark.read.parquet(f"{path}/data")
        rows, digest = _fingerprint(df)
        literal_table(spark, [(source, time.time(), rows, digest)], "source string, written double, n_rows long, content_sum string").coalesce(1).write.mode("overwrite").parquet(f"{path}/provenance")
        return df
    df = spark.read.parquet(f"{path}/data")
    if held["source"] != source:
        raise DataError(f"{path} caches {held['source']}, not {source}")
    if _fingerprint(df) != (held["n_rows"], held["content_sum"]):
        raise DataError(f"{path} changed since it was written")
    return df


def assemble(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Vintages of several series in one table, sorted inside the files for pruning."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
