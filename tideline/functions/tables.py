"""Small tables that a configuration or a driver-side plan consists of."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tables kept for their readers, newest last: (application, table).
_HELD: deque[tuple[str, DataFrame]] = deque()


def hold(df: DataFrame, most: int = 4) -> DataFrame:
    """``df`` kept for plans that read it several times; the oldest beyond ``most`` such tables is released.

    A plan that still reads a released table computes it again.
    """
    app = df.sparkSession.sparkContext.applicationId
    _HELD.append((app, df.persist()))
    while len(_HELD) > most:
        owner, old = _HELD.popleft()
        if owner == app:
            old.unpersist()
    return df


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """``rows`` as a local relation: unlike rows from an RDD it has a known size, so the optimizer can weigh its joins."""
    names, kinds = zip(*(c.split() for c in columns.split(",")))
    arrays = [pa.array([r[k] for r in rows], type=_KINDS[kind]) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(pa.table(arrays, names=list(names)))
