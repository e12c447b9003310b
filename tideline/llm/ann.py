"""Nearest neighbours by randomly rotated one-bit codes.

Every vector, less the mean of a bounded sample, is rotated at random into
``bits`` dimensions; the signs are its packed code. With the length of the
difference and the code's own inner product with the rotated unit vector (two
correction scalars), the inner product with a query is estimated from the code
without bias. The query is rotated and quantised to ``PLANES`` bits a
dimension, so the estimate is a sum of popcounts of packed words. Its error is
bounded by the code's own loss and the query's rounding, with a probability
that ``bound`` sets.

A query starts from a floor, its ``k``-th best exact score within the same
bounded sample (a lower bound of its ``k``-th best over all rows), and meets
the codes in blocks, where the exact scores of the candidates with the best
estimates raise the floor. Candidates whose upper bound lies below it are
passed over; all others are reranked with the original vectors in double
precision.

Blocks of queries meet blocks of candidates in a grid, so a task holds two
bounded blocks, whatever the table's size, and returns ``k`` rows a query; the
tasks of one query are merged by a window over these. A vector is sent once to
each block of the other kind. Nothing is broadcast but
the rotation and the sample, whose sizes the parameters bound.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id or of another length than the most common
one (the smaller, on a tie). Every other row is a candidate of every query but
of itself; rows that repeat an id are rows of their own, as queries too. Equal
scores go by the smaller id. An empty table gives no rows. Columns beyond
``vec_id`` and ``embedding`` are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import arrow_map, durable, hash_sample

SAMPLE = 4096  # vectors that the centre and the floors are taken from, at most
PLANES = 4  # bits a dimension of a rotated query
BLOCK = 32768  # candidates in a block, about
QUERY_BLOCK = 16384  # queries in a block, about


def usable(vectors: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """(vec_id, v, ...): rows that may take part; v holds little-endian doubles."""

    def run(batch):
        ids = batch.column("vec_id")
        column = batch.column("embedding")
        lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
        flat = column.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype("<f8")  # null becomes nan
        ends = np.cumsum(np.maximum(lengths, 0))
        starts = ends - np.maximum(lengths, 0)
        good = lengths > 0
        if len(values):
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            some = np.concatenate(([0], np.cumsum(values != 0)))
            good &= (bad[ends] == bad[starts]) & (some[ends] > some[starts])
        keep = np.flatnonzero(good)
        out = {"vec_id": ids.take(pa.array(keep)), "v": [values[starts[i] : ends[i]].tobytes() for i in keep]}
        return out | {c: batch.column(c).take(pa.array(keep)) for c in extra}

    kinds = dict(vectors.dtypes)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *extra)
    return arrow_map(rows, run, "vec_id long, v binary" + "".join(f", {c} {kinds[c]}" for c in extra))


def common_length(rows: DataFrame) -> int | None:
    """The most frequent length in bytes; the smaller, on a tie."""
    top = rows.groupBy(F.length("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return top.n if top else None


def matrix(column) -> np.ndarray:
    """Rows of doubles from a column of equally long binaries."""
    raw = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 0))


class Codes:
    """The fixed rotation and centre, the codes of vectors and estimates from them."""

    def __init__(self, dim: int, bits: int, centre: np.ndarray, seed: int = 20240501):
        self.dim, self.bits, self.centre = dim, 64 * math.ceil(max(bits, dim) / 64), centre
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, dim)))
        self.rotation = q * np.sign(np.diag(r))  # orthonormal columns: vectors padded to ``bits`` and rotated

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs in 64-bit words, the length of x - centre, and the code's inner product with the rotated unit vector."""
        d = x - self.centre
        length = np.linalg.norm(d, axis=1)
        o = (d / np.maximum(length, 1e-300)[:, None]) @ self.rotation.T
        return np.packbits(o >= 0, axis=1).view(np.uint64), length, np.maximum(np.abs(o).sum(axis=1) / math.sqrt(self.bits), 1e-12)

    def quantise(self, queries: np.ndarray) -> dict[str, np.ndarray]:
        """Rotated queries as bit planes (queries, PLANES, words), the least first, and what the estimate needs of them."""
        rotated = queries @ self.rotation.T
        low = rotated.min(axis=1)
        step = np.maximum((rotated.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
        level = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([np.packbits(level >> j & 1, axis=1).view(np.uint64) for j in range(PLANES)], axis=1)
        loss = np.linalg.norm(rotated - low[:, None] - step[:, None] * level, axis=1)
        return {"planes": planes, "low": low, "step": step, "sum": rotated.shape[1] * low + step * level.sum(axis=1), "loss": loss, "centre": queries @ self.centre, "norm": np.linalg.norm(queries, axis=1)}

    def estimate(self, q: dict[str, np.ndarray], words: np.ndarray, length: np.ndarray, own: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors) and the half-width of their bounds; ``words``: (words, vectors)."""
        n, m = len(q["low"]), words.shape[1]
        common, ones = np.empty((n, m), np.uint64), np.empty((n, m), np.uint8)
        got = np.zeros((n, m), np.uint16 if self.bits << PLANES < 1 << 16 else np.uint32)
        for j in range(PLANES - 1, -1, -1):
            np.left_shift(got, 1, out=got)
            for w in range(len(words)):
                np.bitwise_and(q["planes"][:, j, w, None], words[w], out=common)
                np.bitwise_count(common, out=ones)
                np.add(got, ones, out=got)
        scale = length / own / math.sqrt(self.bits)
        short = lambda x: x.astype(np.float32)
        signed = got * short(2 * q["step"])[:, None]
        signed += short(2 * q["low"])[:, None] * np.bitwise_count(words).sum(axis=0, dtype=np.float32)
        signed -= short(q["sum"])[:, None]
        signed *= short(scale)
        signed += short(q["centre"])[:, None]
        spread = length * np.sqrt(np.maximum(1 - own**2, 0)) / own / math.sqrt(max(self.bits - 1, 1)) * bound + 1e-5 * (length + np.linalg.norm(self.centre))
        return signed, short(q["norm"])[:, None] * short(spread) + short(bound * q["loss"])[:, None] * short(scale)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, summed from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def search_block(codes: Codes, q_rows, q, floor, c_rows, c_ids, c, words, length, own, k: int, bound: float, cells: int = 1 << 20):
    """The ``k`` best of one block of candidates for each query, (query, candidate, score) by place, and the number of reranked pairs."""
    out, reranked, tile = [], 0, max(1, cells // max(1, len(c_rows)))  # queries at a time: ``cells`` estimates
    for first in range(0, len(q_rows), tile):
        part = slice(first, first + tile)
        mine = q[part]
        estimate, half = codes.estimate(codes.quantise(mine), words, length, own, bound)
        other = q_rows[part, None] != c_rows[None, :]
        least = floor[part]
        if len(c_rows) > 2 * k + 1:  # the exact scores of the most promising candidates raise the floor
            hopes = np.argpartition(np.where(other, estimate, -np.inf), -2 * k, axis=1)[:, -2 * k :]
            some = np.einsum("ij,ihj->ih", mine, c[hopes])
            least = np.maximum(least, np.partition(some, k, axis=1)[:, k] - 1e-9 * np.abs(some).max(axis=1))
        estimate += half
        rows, cols = np.nonzero((estimate >= least[:, None]) & other)
        reranked += len(rows)
        scores = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 15):
            b = slice(a, a + (1 << 15))
            scores[b] = np.einsum("ij,ij->i", mine[rows[b]], c[cols[b]])
        pass_ = scores >= least[rows]
        rows, cols, scores = rows[pass_], cols[pass_], scores[pass_]
        order = np.lexsort((c_rows[cols], c_ids[cols], -scores, rows))
        rows, cols = rows[order], cols[order]
        starts = np.flatnonzero(np.r_[True, np.diff(rows) != 0]) if len(rows) else np.zeros(0, int)
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        out.append((rows[rank < k] + first, cols[rank < k]))
    rows, cols = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 2
    return rows, cols, exact(q[rows], c[cols]), reranked


def floors(rows: np.ndarray, x: np.ndarray, sample_rows: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best inner product of each query with the sample's other rows, a little less for rounding; -inf where there are fewer."""
    if len(sample) <= k:
        return np.full(len(x), -np.inf)
    out = np.empty(len(x))
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ sample.T
        s[rows[at : at + 512, None] == sample_rows[None, :]] = -np.inf
        out[at : at + 512] = np.partition(s, -k, axis=1)[:, -k]
    return out - 1e-9 * np.linalg.norm(x, axis=1) * np.linalg.norm(sample, axis=1).max()


def nearest(vectors: DataFrame, queries_where, k: int = 20, bits: int = 256, bound: float = 3.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of largest inner product for each query.

    ``queries_where``: a condition on vec_id that says which rows are queries.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    every = durable(usable(vectors.filter("vec_id is not null")).withColumn("row", F.monotonically_increasing_id()))
    size = common_length(every)
    if size is None:
        return spark.createDataFrame([], empty)
    every = every.filter(F.length("v") == size)
    total, asked = every.agg(F.count(F.lit(1)), F.count_if(queries_where)).first()
    drawn = hash_sample(every, ["row"], SAMPLE, total).select("row", "v").collect()
    sample_rows, sample = np.array([r.row for r in drawn]), matrix([bytes(r.v) for r in drawn])
    codes = Codes(size // 8, bits, sample.mean(axis=0))
    query_blocks = max(1, round(asked / query_block))
    busy = min(2 * spark.sparkContext.defaultParallelism // query_blocks, total // 2048)  # a small table is cut finer, for all cores
    candidate_blocks = max(1, round(total / block), busy)

    def encode(batch):
        packed, length, own = codes.encode(matrix(batch.column("v")))
        return {c: batch.column(c) for c in ("vec_id", "row", "v")} | {"code": [p.tobytes() for p in packed], "length": length, "own": own}

    def ask(batch):
        rows = batch.column("row").to_numpy()
        return {c: batch.column(c) for c in ("vec_id", "row", "v")} | {"floor": floors(rows, matrix(batch.column("v")), sample_rows, sample, k)}

    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    columns = "vec_id long, row long, v binary"
    candidates = arrow_map(every.select("vec_id", "row", "v"), encode, columns + ", code binary, length double, own double").select("*", dealt(candidate_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = arrow_map(every.filter(queries_where).select("vec_id", "row", "v"), ask, columns + ", floor double").select("*", dealt(query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))).alias("cb"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        l, r = ({c: t.column(c).to_numpy() for c in t.column_names if c not in ("v", "code")} for t in (left, right))  # noqa: E741
        words = np.ascontiguousarray(np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint64).reshape(right.num_rows, -1).T)
        rows, cols, scores, _ = search_block(codes, l["row"], matrix(left.column("v")), l["floor"], r["row"], r["vec_id"], matrix(right.column("v")), words, r["length"], r["own"], k, bound)
        return pa.table([l["row"][rows], l["vec_id"][rows], r["row"][cols], r["vec_id"][cols], scores], schema=schema)

    ship(spark)
    found = queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb")).applyInArrow(meet, "query_row long, query_id long, row long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
