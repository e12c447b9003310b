"""A corpus pipeline: quality, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; every result is written as Parquet in the shared folder and read
again. All stages but the last return the columns of ``documents``.

Null and empty texts are judged like any other text by the classifiers, and
those that stay are near copies of each other; very long texts are read whole;
repeated rows count as copies; an empty table, or one of which nothing is kept,
gives no rows; columns beyond those of ``documents`` are carried along to the
last stage, whatever their names. The classifiers learn from the corpus itself,
``documents`` and ``labels`` of ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import packing, quality, secretscan, simhash, toxicity
from .common import shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, weights)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: The classifiers are beyond SQL; tests hold the pipeline against its operators run by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; a stage's table is removed once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
