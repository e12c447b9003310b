"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Features are word and symbol tokens and pairs of neighbouring tokens, hashed
into ``2 ** bits`` buckets; a document is the L2-normalised vector of the
square roots of its counts. Training follows the regularised leader over a
bounded, documented sample of labelled rows; scoring is one sparse dot product
per document.

Null text counts as empty; an empty text has no features, so its score is the
sigmoid of the bias. A repeated row is scored like the first. Columns beyond
``doc_id`` and ``text`` are ignored by :func:`score` and kept by
:func:`accepted`. Without a labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import arrow_map, arrow_rows, durable, few_rows, id_remainder, labelled_sample, text_batches


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    per_class: int = 2500  # labelled documents of each class that are learned from, at most
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    divisor: int = 5
    held: int = 0
    threshold: float = 0.3


def document_features(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (rising) and values of one text; memory follows a chunk and the buckets."""
    parts, carry = [], np.zeros(0, np.uint64)
    dense = None
    for piece in bytehash.pieces(raw):
        _, _, h = bytehash.tokens(np.frombuffer(piece, np.uint8))
        both = np.concatenate((h, bytehash.pairs(np.concatenate((carry, h))))) if len(h) else h
        parts.append((both >> np.uint64(64 - bits)).astype(np.int64))
        carry = h[-1:] if len(h) else carry
        if len(parts) > 4:
            dense = (0 if dense is None else dense) + np.bincount(np.concatenate(parts), minlength=1 << bits)
            parts = []
    rest = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if dense is not None:
        dense = dense + np.bincount(rest, minlength=1 << bits)
        index = np.flatnonzero(dense)
        counts = dense[index]
    else:
        index, counts = np.unique(rest, return_counts=True)
    values = np.sqrt(counts)
    norm = np.sqrt(counts.sum())
    return index, (values / norm if norm else values).astype(np.float64)


class Ftrl:
    """Per-coordinate FTRL-proximal with lazy weights."""

    def __init__(self, size: int, s: Settings):
        self.s, self.z, self.n = s, np.zeros(size), np.zeros(size)

    def weights(self, index) -> np.ndarray:
        s, z = self.s, self.z[index]
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[index])) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, index: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = weight * (p - label) * values
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[index] = n + g * g


def learned(labels: list[int], visit: Callable[[np.ndarray], Iterable[tuple[int, bytes, bytes]]], s: Settings) -> np.ndarray:
    """Weights, the bias last; both classes weigh alike. ``visit`` gives (label, indices int32, values float32) of the rows in the order it gets."""
    model = Ftrl((1 << s.bits) + 1, s)
    if not labels:
        return np.zeros((1 << s.bits) + 1, np.float32)
    ones = sum(labels)
    weight = [len(labels) / (2 * max(1, len(labels) - ones)), len(labels) / (2 * max(1, ones))]
    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for y, i, v in visit(rng.permutation(len(labels))):
            model.learn(np.append(np.frombuffer(i, np.int32), 1 << s.bits), np.append(np.frombuffer(v, np.float32), 1.0), y, weight[y])
    return model.weights(slice(None)).astype(np.float32)


def train(rows: list[tuple[int, int, bytes, bytes]], s: Settings) -> np.ndarray:
    """Weights from rows at hand: (doc_id, label, indices int32, values float32)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    return learned([r[1] for r in rows], lambda order: (rows[k][1:] for k in order), s)


def train_streamed(found: DataFrame, size: int, part: int, s: Settings) -> np.ndarray:
    """The same from a durable table (row, doc_id, label, i, v) of ``size`` bytes: in each epoch the driver gets its rows in that epoch's order, about ``part`` bytes at a time."""
    keys = sorted((r.doc_id, r.label, r.row) for r in found.select("doc_id", "label", "row").collect())

    def visit(order):
        places = found.sparkSession.createDataFrame([(keys[k][2], at) for at, k in enumerate(order.tolist())], "row long, place int")
        dealt = found.join(F.broadcast(places), "row").repartitionByRange(max(1, -(-size // part)), "place").sortWithinPartitions("place")
        return ((r.label, bytes(r.i), bytes(r.v)) for r in dealt.select("label", "i", "v").toLocalIterator())

    return learned([k[1] for k in keys], visit, s)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), at_once: int = 1 << 26) -> np.ndarray:
    """Features of long texts reach 2 MB each; beyond ``at_once`` bytes of them the driver reads them in parts, to the same weights."""
    sample = labelled_sample(docs, labels, "quality", s.divisor, s.held, s.per_class)

    def features(batch):
        for doc_id, label, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
            index, values = document_features((t or "").encode("utf-8", "surrogatepass"), s.bits)
            yield {"doc_id": [doc_id], "label": [label], "i": [index.astype(np.int32).tobytes()], "v": [values.astype(np.float32).tobytes()]}

    found = durable(arrow_map(sample, features, "doc_id long, label int, i binary, v binary").withColumn("row", F.monotonically_increasing_id()))
    size = found.agg(F.sum(F.length("i") + F.length("v"))).first()[0] or 0
    if size > at_once:
        return train_streamed(found, size, max(1, at_once // 4), s)
    return train([(r.doc_id, r.label, bytes(r.i), bytes(r.v)) for r in found.collect()], s)


def score_texts(texts: list[str | None], weights: np.ndarray, bits: int) -> np.ndarray:
    """Scores of whole texts; many short ones are hashed in one pass."""
    out = np.zeros(len(texts))
    shift = np.uint64(64 - bits)
    for first, raws in text_batches(texts):
        if len(raws) == 1:
            index, values = document_features(raws[0], bits)
            out[first] = weights[index].astype(np.float64) @ values
            continue
        lengths = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        starts, _, h = bytehash.tokens(data)
        doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
        same = doc[1:] == doc[:-1]
        bucket = np.concatenate((h, bytehash.pairs(h)[same] if len(h) else h)) >> shift
        owner = np.concatenate((doc, doc[1:][same]))
        keys, counts = np.unique((owner.astype(np.uint64) << np.uint64(bits)) | bucket, return_counts=True)
        owner, bucket = (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        dots = np.bincount(owner, weights[bucket] * np.sqrt(counts), minlength=len(raws))
        norms = np.sqrt(np.bincount(owner, counts, minlength=len(raws)))
        out[first : first + len(raws)] = dots / np.maximum(norms, 1)
    return 1 / (1 + np.exp(-np.clip(out + float(weights[-1]), -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batch):
        return {"doc_id": batch.column("doc_id"), "score": score_texts(batch.column("text").to_pylist(), weights, s.bits)}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, s), s)
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", s.divisor) == s.held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with a score of the threshold or more, columns unchanged; nothing is shuffled."""
    import pyarrow as pa

    def run(batches):
        for batch in few_rows(batches):
            yield batch.filter(pa.array(score_texts(batch.column("text").to_pylist(), weights, s.bits) >= s.threshold))

    return arrow_rows(docs, run, docs.schema)
