"""SimHash near-duplicates by covering locality-sensitive hashing.

The fingerprint is a 64-bit majority vote over the XXH64 values (seed 42) of a
document's shingles of four words. Equal fingerprints are first merged, so a
group of copies costs one row. The distinct fingerprints are then hashed under
31 bit masks: bit i belongs to a nonzero vector c(i) of GF(2)^5, and mask v
keeps the bits with <c(i), v> = 1. Four differing bits span at most four
dimensions, so some nonzero v is orthogonal to all of them: every pair within
four bits agrees under some mask, without exception.

Buckets with more than ``bucket`` members are split by the same construction
over the bits that their mask leaves out, at most twice, and what is still
larger is dealt to pairs of blocks; so no task holds an unbounded group and no
pair is lost. A task returns a forest of its links, never all pairs.

Null text counts as empty; a text without a word has the fingerprint zero and
links like any other. Memory follows one text's words, however long it is.
Repeated rows each keep a row. A row with a null id keeps its fingerprint, adds
no id to its component and gets the component of its fingerprint (null if only
null ids share it). An empty table gives no rows. Extra columns are ignored by
:func:`clusters` and kept by :func:`deduplicate`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, arrow_rows, durable, few_rows, heavy_keys, spread_join
from .components import connected_components

WORDS, RADIUS, SEED = 4, 4, 42
BLOCK = 1 << 16  # shingles voted on at a time


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; memory beyond the words follows a block of shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(0, len(words) - WORDS + 1) or bool(words)
    if not n:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[WORDS - 1 :].tolist() if len(words) >= WORDS else [len(line)]
    votes = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the fingerprint's bits as a signed long."""

    def run(batch):
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": values.view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Signed 64-bit masks over the given bit places that cover ``radius``."""
    size = 1 << (radius + 1)
    vectors = {bit: k % (size - 1) + 1 for k, bit in enumerate(bits)}
    masks = [sum(1 << bit for bit, c in vectors.items() if (c & v).bit_count() & 1) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


FIRST = covering_masks(list(range(64)), RADIUS)
SECOND = [covering_masks([b for b in range(64) if not (m >> b) & 1], RADIUS) for m in FIRST]


def links_in(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs within ``radius`` inside each run of equal keys (sorted): (node, smallest node of its tree)."""
    n = len(keys)
    parent = np.arange(n)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, n])
    end = np.repeat(first + size, size)
    a, step = np.arange(n), 1
    while True:
        a = a[a + step < end[a]]
        if not len(a):
            break
        near = np.bitwise_count(fps[a] ^ fps[a + step]) <= radius
        i, j = a[near], a[near] + step
        while len(i):  # join the trees of i and j under the smaller root
            ri, rj = parent[i], parent[j]
            differ = ri != rj
            i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
            if not len(i):
                break
            np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
        step += 1
    tree = np.minimum.reduceat(nodes[np.argsort(parent, kind="stable")], np.flatnonzero(np.r_[True, np.diff(np.sort(parent)) != 0])) if n else nodes
    root = tree[np.unique(parent, return_inverse=True)[1]] if n else nodes
    own = nodes != root
    return nodes[own], root[own]


def _with_masks(rows: DataFrame) -> DataFrame:
    """(k1, k2, level, fp, rep) from (fp, rep): one row for each first mask."""
    masks = F.array(*[F.struct(F.lit(t).alias("t"), (F.col("fp").bitwiseAND(F.lit(m))).alias("key")) for t, m in enumerate(FIRST)])
    return rows.select("fp", "rep", F.explode(masks).alias("m")).select("fp", "rep", F.col("m.t").alias("t"), F.col("m.key").alias("key"))


def _link_buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Forest links of buckets of bounded size: rows dealt and sorted by ``keys``, streamed group by group."""
    # The work follows comparisons, not bytes: partitions of few bytes aren't merged into tasks of much work.
    partitions = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = rows.repartition(int(partitions), *keys).sortWithinPartitions(*keys)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[np.ndarray] = []

        def flush(block: np.ndarray):
            order = np.lexsort(block[:-2][::-1])
            block = block[:, order]
            change = np.r_[True, (block[:-2, 1:] != block[:-2, :-1]).any(axis=0)]
            a, b = links_in(np.cumsum(change), block[-2].view(np.uint64), block[-1], RADIUS)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            block = np.concatenate(held, axis=1)
            last = (block[:-2] != block[:-2, -1:]).any(axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = [block[:, cut:]]
            if cut:
                yield flush(block[:, :cut])
        if held and held[0].shape[1]:
            yield flush(np.concatenate(held, axis=1))

    return arrow_rows(dealt.select(*keys, "fp", "rep"), run, "a long, b long")


def fingerprint_links(distinct: DataFrame, bucket: int = 2000) -> DataFrame:
    """Links (a, b) between representatives that keep the components of "within four bits".

    ``distinct``: (fp, rep), one row for each fingerprint.
    """
    first = _with_masks(distinct)
    count = first.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = first.join(count, ["t", "key"])
    rows = durable(rows)
    links = _link_buckets(rows.filter(F.col("n") <= bucket), ["t", "key"])
    hot = rows.filter(F.col("n") > bucket)
    if hot.limit(1).count() == 0:
        return links
    # The bits outside the first mask, hashed again; t and key stay part of the key.
    table = F.array(*[F.array(*[F.lit(m) for m in masks]) for masks in SECOND])
    second = hot.select("t", "key", "fp", "rep", F.posexplode(F.get(table, F.col("t"))).alias("s", "mask")).select("t", "key", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("low"), "fp", "rep")
    count = second.groupBy("t", "key", "s", "low").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    second = durable(second.join(count, ["t", "key", "s", "low"]))
    links = links.union(_link_buckets(second.filter(F.col("n") <= bucket), ["t", "key", "s", "low"]))
    # What is larger still: every pair of blocks of at most ``bucket`` members or so meets in a group of its own.
    blocks: Column = F.ceil(F.col("n") / bucket).cast("int")
    dealt = (
        second.filter(F.col("n") > bucket)
        .withColumn("g", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("t", "key", "s", "low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    )
    return links.union(_link_buckets(dealt, ["t", "key", "s", "low", "i", "j"]))


def classes(docs: DataFrame, bucket: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, fp) of every row; (fp, class, component_id) of every fingerprint; the fingerprints that very many rows share.

    A class is a component of fingerprints, named by the smallest of these (as
    a signed number), so rows that share an id by mistake stay apart.
    """
    prints = durable(fingerprints(docs))
    heavy = heavy_keys(prints, ["fp"], prints.count())
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(fingerprint_links(distinct.filter("least is not null").select("fp", F.col("fp").alias("rep")), bucket))
    named = durable(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class")))
    ids = named.groupBy("class").agg(F.min("least").alias("component_id"))
    return prints, spread_join(named.drop("least"), ids, ["class"], heavy_keys(named, ["class"], named.count())), heavy


def clusters(docs: DataFrame, bucket: int = 2000) -> DataFrame:
    """doc_id, fp (signed bits) and component_id of every row of ``docs``."""
    prints, named, heavy = classes(docs, bucket)
    return spread_join(prints, named, ["fp"], heavy).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, bucket: int = 2000) -> DataFrame:
    """One row of each component, columns and their names unchanged: the row with its smallest id; rows with a null id stay.

    Rows that share an id are judged each by its own text, so none is lost to
    a row that is no copy of it; of those that share id and component too, the
    first by its columns' JSON stays.
    """
    names = docs.columns
    inner = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"))
    prints, named, heavy = classes(docs.select("doc_id", "text"), bucket)
    judged = spread_join(prints, named, ["fp"], heavy)
    count = durable(judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("firsts")).filter("firsts > 0"))
    kept = inner.join(count.filter("n = 1"), F.col("id") == F.col("doc_id"), "left_semi").select("row")
    repeated = count.filter("n > 1").select("doc_id")
    if not repeated.isEmpty():
        several = _with_fingerprints(inner.join(repeated, F.col("id") == F.col("doc_id"), "left_semi"))
        wanted = judged.filter("doc_id = component_id").join(repeated, "doc_id", "left_semi").select("doc_id", "fp", "class").distinct()
        again = several.join(wanted, (several.id == wanted.doc_id) & (several.fp == wanted.fp)).groupBy("id", "class").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.unionByName(again.select("row"))
    return kept.unionByName(inner.filter("id is null").select("row")).select("row.*").toDF(*names)


def _with_fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` with the fingerprint of ``text`` as the column fp."""

    def run(batches):
        import pyarrow as pa

        for batch in few_rows(batches):
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, "fp"])

    return arrow_rows(rows, run, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())]))


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
