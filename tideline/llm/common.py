"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one on one machine (tests), and an error
    on a cluster, whose executors could not see it.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"ckpt-{uuid.uuid4().hex}"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that turn a batch into columns (a dict), or yield several; see :func:`few_rows`."""
    ship(df.sparkSession)
    arrow_schema = to_arrow(df.sparkSession, schema)

    def run(batches):
        for batch in few_rows(batches):
            made = function(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a worker holds few texts as Python objects at a time; none is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema))


def text_batches(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of encoded texts of about ``limit`` bytes at most, with the place of the first; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def hash_sample(rows: DataFrame, keys: list[str], most: int, total: int) -> DataFrame:
    """At most ``most`` of ``total`` rows, the first by the hash of ``keys``; the same in every run.

    A threshold on the hash leaves about 1.5 times as many rows, wherever they
    lie, so the sort that follows never sees more than that.
    """
    marked = rows.withColumn("_hash", F.xxhash64(*keys))
    share = (1.5 * most + 50) / max(1, total)
    if share < 1:
        marked = marked.filter(F.pmod(F.col("_hash"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return marked.orderBy(F.pmod(F.col("_hash"), F.lit(1 << 40)), "_hash", *keys).limit(most).drop("_hash")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, divisor: int, held: int, per_class: int) -> DataFrame:
    """At most ``per_class`` documents of each class: (label, text).

    Rows held out (crc32 remainder ``held``) never appear. The choice is by the
    hash of the id, so it is the same in every run. ``per_class`` bounds the
    ids, and so makes the broadcast safe at any size of the corpus.
    """
    usable = (
        labels.select(F.col("doc_id"), F.col(target).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & (id_remainder("doc_id", divisor) != held))
        .groupBy("doc_id")
        .agg(F.max("_label").alias("_label"))
    )
    counts = {r._label: r.n for r in usable.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    parts = [hash_sample(usable.filter(F.col("_label") == c), ["doc_id"], per_class, counts.get(c, 0)) for c in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), "_label")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_label").alias("label"), "text")


HEAVY, FEW = 10_000, 200


def heavy_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """(keys..., parts) of keys that hold more than a ``HEAVY``-th of ``total`` rows (and more than ``FEW``); None if there is none.

    Whatever the table, fewer than ``HEAVY`` keys can; so the result may come to the driver and be broadcast.
    """
    if total <= FEW:
        return None
    bound = max(FEW, total // HEAVY)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).select(*keys, F.ceil(F.col("_n") / bound).cast("int").alias("_parts"))
    held = found.collect()  # fewer than HEAVY rows
    return rows.sparkSession.createDataFrame(held, found.schema) if held else None


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one`` (a row for each key) where heavy keys are dealt over their parts: no task gets one whole."""
    if heavy is None:
        return many.join(one, keys, how)
    known = F.broadcast(heavy)  # fewer than HEAVY rows, see there
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(known, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("_parts")
    right = one.join(known, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")
