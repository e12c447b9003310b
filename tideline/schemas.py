"""Column contracts of the tables, and the normaliser that every scan goes through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"STRING": T.StringType(), "DATE": T.DateType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(), "BOOLEAN": T.BooleanType()}


def struct(ddl: str) -> T.StructType:
    """A flat schema; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in ddl.split(","))])


VINTAGE = struct("series_id STRING, vintage_date DATE, observation_date DATE, value DOUBLE")
BACKFILL = struct("is_synthesized BOOLEAN, backfill_reference_vintage DATE, backfill_anchor_date DATE, backfill_method STRING")
METRIC_PANEL = struct("strategy STRING, forecast_origin STRING, group STRING, target_quarter STRING, horizon_quarters INT, variable STRING, forecast_method STRING, actual_metric DOUBLE, mean_metric DOUBLE, error_metric DOUBLE")
DRAWS_PANEL = struct("strategy STRING, model_size STRING, forecast_origin STRING, target_quarter STRING, horizon_quarters INT, variable STRING, mean DOUBLE, actual DOUBLE, error DOUBLE")
CANONICAL = ["model", "family", "size", "scope", "selection", "forecast_method", "group", "forecast_origin", "origin_ord", "target", "horizon", "variable", "forecast", "actual", "error"]
CELL = ["variable", "horizon"]
OBSERVATION = ["group", "forecast_origin", "target"]


class DataError(ValueError):
    """A table breaks its contract."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null, once, where data enters."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError(f"{what} lacks {', '.join(missing)}")
    return df
