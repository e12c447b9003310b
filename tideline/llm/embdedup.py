"""Near-duplicate embeddings: iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected on principal axes and rotated so that
their signs lose least (iterative quantisation on a bounded sample); the signs
are balanced binary codes. The code is cut into substrings, each the key of a
hash table, beside the label. Two vectors are candidates if they agree in at
least one substring, however many bits they differ in. A bit of a pair at angle
a seen from the centre differs with a chance of about a / pi (0.064 at a cosine
of 0.98 and a centre of 0), so with substrings of ``chunk`` bits the pair is
missed with a chance of (1 - (1 - a / pi)^chunk)^tables. The substring grows
with the logarithm of the largest label's rows, which keeps buckets small, and
the tables with it, so that over the sample about one in a thousand pairs at
the very threshold is missed, and fewer above. Pairs near the centre are seen
at a wider angle; where that would take more than twice the tables, codes are
not centred and their buckets are larger. Candidates are reranked with the
original vectors in double precision, so no pair below the threshold is linked.

Equal vectors of a label are merged first, so copies cost one row; merged rows
count each other as links. A pair that meets in several tables is counted in
the first of them only, so link counts are sums of partial counts and pairs
are never written out; a task also returns a forest of its links for the
components. A bucket of more than ``block`` members is dealt to pairs of
blocks, each a group of its own: no task holds more than two blocks, and no
pair is lost.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do those without a label or of another length than the most
common one: their component is their own id and they are kept. Each row stays
a row; rows that repeat an id stand for the same node. Without an id a row has
no component, is not kept, and still counts as a link of its equals. An empty
table gives no rows. Columns beyond ``vec_id``, ``embedding`` and ``label`` are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import common_length, matrix, usable
from .common import arrow_map, arrow_rows, durable, hash_sample, heavy_keys, spread_join
from .components import connected_components

SAMPLE = 8192  # vectors that the rotation is learned from, at most
BLOCK = 1500  # members of a bucket that one task compares directly


def learn_rotation(x: np.ndarray, rounds: int = 30, seed: int = 11, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(centre, matrix): codes are the signs of (unit - centre) @ matrix, as many bits as dimensions."""
    centre = x.mean(axis=0) if centred else np.zeros(x.shape[1])
    d = x - centre
    _, axes = np.linalg.eigh(d.T @ d)
    v = d @ axes
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1],) * 2))[0]
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return centre, axes @ r


def units(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    y = x / scale
    return y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


def tables_needed(squares: np.ndarray, chunk: int, threshold: float, most: int, miss: float = 0.001) -> int:
    """Tables, ``most`` + 1 at most, that miss a share ``miss`` of pairs at the threshold, for squared distances of unit vectors to the centre."""
    possible = squares[2 * squares >= 1 - threshold]  # nearer to the centre no pair is so far apart
    agree = (1 - np.arccos(np.clip(1 - (1 - threshold) / np.maximum(possible, 1e-300), -1, 1)) / np.pi) ** chunk
    return next((n for n in range(1, most + 1) if not len(agree) or ((1 - agree) ** n).mean() <= miss), most + 1)


def tables_for(bits: int, chunk: int, threshold: float, count: int) -> np.ndarray:
    """(table, chunk) bit places, ``count`` or as many as the code has: neighbouring substrings of the code, then of shuffled orders of its bits."""
    count = max(count, bits // chunk) if threshold < 1 else 1
    rng, orders = np.random.default_rng(3), [np.arange(bits)]
    while sum(len(o) // chunk for o in orders) < count:
        orders.append(rng.permutation(bits))
    return np.concatenate([o[: len(o) // chunk * chunk].reshape(-1, chunk) for o in orders])[:count]


def compare(keys, table, keymatrix, unit, weight, ids, threshold: float, own, whole):
    """Partial link counts and a forest over sorted groups.

    ``keys`` number the groups (sorted), ``table`` is each row's table number,
    ``keymatrix`` holds each row's substring of every table. Groups with
    ``whole`` compare all their pairs, others those of different blocks
    (``own``). Returns counts and roots.
    """
    n = len(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    end = np.repeat(first + size, size)
    counts, parent = np.zeros(n, np.int64), np.arange(n)
    a, step = np.arange(n), 1
    while True:
        a = a[a + step < end[a]]
        if not len(a):
            break
        for at in range(0, len(a), 1 << 16):
            i = a[at : at + (1 << 16)]
            j = i + step
            meant = whole[i] | (own[i] != own[j])
            i, j = i[meant], j[meant]
            new = (keymatrix[i] == keymatrix[j]).argmax(axis=1) == table[i]
            i, j = i[new], j[new]
            linked = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            i, j = i[linked], j[linked]
            np.add.at(counts, i, weight[j])
            np.add.at(counts, j, weight[i])
            while len(i):
                ri, rj = parent[i], parent[j]
                differ = ri != rj
                i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
                if not len(i):
                    break
                np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
        step += 1
    return counts, ids[parent]


def duplicates(vectors: DataFrame, threshold: float = 0.98, chunk: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = usable(vectors, ["label"]).filter("label is not null")
    rows = durable(rows)
    size = common_length(rows)
    if size is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    rows = rows.filter(F.length("v") == size)
    merged = durable(rows.groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("node")).withColumn("class_id", F.monotonically_increasing_id()))
    by_label = merged.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    sample = matrix([bytes(r.v) for r in hash_sample(merged, ["label", "v"], SAMPLE, by_label.total).select("v").collect()])
    known = units(sample)
    bits = known.shape[1]
    chunk = min(chunk or int(np.clip(np.ceil(np.log2(by_label.largest / 64)), 8, 24)), bits)
    raw = tables_needed(np.ones(1), chunk, threshold, 1 << 20)
    centred = tables_needed(((known - known.mean(axis=0)) ** 2).sum(axis=1), chunk, threshold, 2 * raw)
    centre, rotation = learn_rotation(known, centred=centred <= 2 * raw)
    places = tables_for(bits, chunk, threshold, centred if centred <= 2 * raw else raw)
    count = len(places)

    def encode(batch):
        u = units(matrix(batch.column("v")))
        code = (u - centre) @ rotation >= 0
        powers = 1 << np.arange(places.shape[1], dtype=np.int64)
        keys = (code[:, places] * powers).sum(axis=2)
        n, order = len(u), np.tile(np.arange(count), len(u))
        take = pa.array(np.repeat(np.arange(n), count))
        return {name: batch.column(name).take(take) for name in ("label", "class_id", "weight")} | {
            "t": order, "key": keys.reshape(-1), "keys": pa.array([k.tobytes() for k in keys]).take(take), "unit": pa.array([x.tobytes() for x in u]).take(take),
        }

    kind = dict(merged.dtypes)["label"]
    coded = arrow_map(merged.select("label", "v", "class_id", "weight"), encode, f"label {kind}, class_id long, weight long, t int, key long, keys binary, unit binary")
    # Bucket sizes need no vectors: counted by an aggregate, joined back to deal out the large ones.
    sizes = coded.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("g", F.ceil(F.col("n") / block).cast("int")).drop("n")
    dealt = (
        coded.join(sizes, ["label", "t", "key"])
        .withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("label", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class_id", "weight", "keys", "unit")
    )
    group = ["label", "t", "key", "i", "j"]
    # The work follows comparisons, not bytes: partitions of few bytes aren't merged into tasks of much work.
    sorted_rows = dealt.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group, "own")

    def run(batches):
        schema = pa.schema([("class_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
        held: pa.Table | None = None

        def flush(t: pa.Table):
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in group])
            keys = np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            ids, weight, own = (t.column(c).to_numpy() for c in ("class_id", "weight", "own"))
            keymatrix = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int64).reshape(len(ids), -1)
            links, root = compare(keys, key[1], keymatrix, matrix(t.column("unit")), weight, ids, threshold, own, key[3] == key[4])
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some]), pa.array(links[some])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            last = np.zeros(held.num_rows, bool)
            for c in group:
                x = held.column(c).to_numpy()
                last |= x != x[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut:
                yield flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield flush(held)

    found = durable(arrow_rows(sorted_rows, run, "class_id long, root long, links long"))
    counted = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("class_id <> root").select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    # Classes become ids: the smallest of a component's.
    named = merged.select("class_id", "label", "v", "weight", "node").join(classes.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    named = durable(named.join(counted, "class_id", "left").select("class_id", "component", "label", "v", "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    least = named.groupBy("component").agg(F.min("node").alias("component_id"))
    found = spread_join(named, least, ["component"], heavy_keys(named, ["component"], by_label.total)).select("label", "v", "n_links", "component_id")
    joined = spread_join(rows, found, ["label", "v"], heavy_keys(rows, ["label", "v"], rows.count())).select("vec_id", "n_links", "component_id")
    # Rows that took no part: all rows less those that did, by id and how often it occurs.
    all_ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return _with_rest(all_ids, joined)


def _with_rest(every: DataFrame, joined: DataFrame) -> DataFrame:
    linked = joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    there = every.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    done = joined.groupBy("vec_id").agg(F.count(F.lit(1)).alias("m"))
    rest = there.join(done, there.vec_id.eqNullSafe(done.vec_id), "left").select(there.vec_id, (F.col("n") - F.coalesce("m", F.lit(0))).alias("r")).filter("r > 0")
    rest = rest.select("vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r"))).alias("_")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return linked.select("vec_id", "n_links", "component_id", "kept").unionByName(rest)
