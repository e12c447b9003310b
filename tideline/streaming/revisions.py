"""Newest values from a stream of vintage rows: (series_id, vintage_date, observation_date, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VINTAGE


def vintage_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of vintage rows as they arrive; rows that look ahead of their vintage are left out."""
    return spark.readStream.schema(VINTAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder).filter(F.col("observation_date") <= F.col("vintage_date"))


def newest(stream: DataFrame) -> DataFrame:
    """Each observation's value in its newest vintage and the number of rows seen, in update or complete mode.

    The state holds a row for each observation, whatever the number of its
    revisions; late rows of old vintages change nothing but the count.
    """
    return stream.groupBy("series_id", "observation_date").agg(F.max_by("value", "vintage_date").alias("value"), F.max("vintage_date").alias("vintage_date"), F.count(F.lit(1)).alias("n_rows"))


def once_each(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Rows without repetitions, as far back as the watermark on the vintage reaches."""
    timed = stream.withColumn("vintage_time", F.col("vintage_date").cast("timestamp")).withWatermark("vintage_time", delay)
    return timed.dropDuplicatesWithinWatermark(["series_id", "vintage_date", "observation_date"]).drop("vintage_time")
