"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary documents
and one on windows of toxic ones. Most windows of a toxic document read like
any other, so both are trained on what tells: windows that shared ordinary
text compresses badly, and, in a second round, toxic windows that the first
round's toxic dictionary (of the other half of the documents) compresses
better than the ordinary one, by more than nearly all ordinary windows.

A text is cut into windows at white space. Each is compressed twice, with the
ordinary and with the toxic dictionary. Both lie before the same shared
ordinary text, so common wording costs the same either way, and the difference
of the two lengths shows what only one of the dictionaries holds. A document
is scored from its windows' differences by thresholds and a logistic
calibration, learned from labelled documents that the dictionaries have not
seen, whole. A small committee of such pairs, each dealt other halves of the
documents, is averaged.

Null text counts as empty; an empty text has no window and gets the score of
"no window differs". Whole texts are scored, window by window, so memory
doesn't follow their length. Repeated rows are scored alike, and ids may be
null. Without toxic or without ordinary training rows every score is next to
0. An empty table gives no rows. Columns beyond ``doc_id`` and ``text`` are
ignored by :func:`score` and kept by :func:`accepted`, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, durable, few_rows, id_remainder, labelled_sample


@dataclass(frozen=True)
class Settings:
    """Chosen by cross-validation inside rows that may be learned from."""

    per_class: int = 2400  # labelled documents of each class that are learned from, at most
    pieces: int = 64  # of each of them that dictionaries see, at most: drawn from the whole text
    piece: int = 128  # bytes of a piece, about
    window: int = 200  # bytes that are compressed at a time, about
    committee: int = 4
    shared_bytes: int = 65536
    class_bytes: int = 4096
    hard: float = 0.8  # share of ordinary windows that shared text compresses better than a window worth learning
    telling: float = 0.98  # share of ordinary windows that a toxic one of the second round must exceed
    divisor: int = 4
    held: int = 2
    threshold: float = 0.3


#: Lazy search with room for the dictionaries: faster strategies miss matches at random, and their noise hides the differences.
SEARCH = zstandard.ZstdCompressionParameters(
    strategy=zstandard.STRATEGY_LAZY, window_log=17, hash_log=16, chain_log=17, search_log=4, min_match=4, target_length=64, write_content_size=False, write_dict_id=False, write_checksum=False
)
FEATURES = 9


def windows(raw: bytes, size: int):
    """Parts of at most ``size`` bytes, cut behind white space where there is some in the second half."""
    at, n = 0, len(raw)
    while at < n:
        end = at + size
        if end < n:
            cut = max(raw.rfind(b" ", at + size // 2, end), raw.rfind(b"\n", at + size // 2, end))
            end = cut + 1 if cut > 0 else end
        yield raw[at:end]
        at = end


def compressor(content: bytes):
    """Compresses with ``content`` at hand. A trained dictionary's content counts; its entropy tables, fitted to a class as a whole, do not."""
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=SEARCH)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=SEARCH).compress


class Model:
    """Pickles as dictionaries and numbers; compressors are made where they are used."""

    def __init__(self, pairs: list[tuple[bytes, bytes, bytes]], coefficients: np.ndarray, s: Settings):
        self.pairs, self.coefficients, self.s = pairs, coefficients, s  # pairs: ordinary, toxic, shared
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def compressors(self):
        if self._made is None:
            self._made = [(compressor(o + shared), compressor(t + shared)) for o, t, shared in self.pairs]
        return self._made

    def features(self, raw: bytes) -> np.ndarray:
        """Of the bytes that the toxic dictionary saves in each window: scaled sum, mean, greatest, roots of the shares of at least 2, 3, 4, 6 and at most -3; the logarithm of the length."""
        out = np.zeros(FEATURES)
        for ordinary, toxic in self.compressors():
            saved = Counter(len(ordinary(w)) - len(toxic(w)) for w in windows(raw, self.s.window))
            n = max(1, sum(saved.values()))
            total = sum(k * c for k, c in saved.items())
            share = [sum(c for k, c in saved.items() if k >= t) / n for t in (2, 3, 4, 6)] + [sum(c for k, c in saved.items() if k <= -3) / n]
            out += np.r_[total / np.sqrt(n), total / n, min(max(saved, default=0), 12), np.sqrt(share), np.log1p(len(raw))]
        return out / max(1, len(self.pairs))

    def score(self, raws) -> np.ndarray:
        x = np.array([self.features(r) for r in raws], float).reshape(-1, FEATURES)
        z = np.column_stack((np.ones(len(x)), x)) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def encoded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def drawn(raw: bytes, seed: int, s: Settings) -> list[bytes]:
    """At most ``pieces`` pieces of a whole text, drawn at random."""
    found = list(windows(raw, s.piece))
    if len(found) <= s.pieces:
        return found
    return [found[k] for k in sorted(np.random.default_rng(seed).permutation(len(found))[: s.pieces])]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Newton's method on standardised columns; coefficients for raw columns, intercept first."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack((np.ones(len(x)), (x - mean) / deviation))
    w, penalty = np.zeros(a.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / deviation).sum(), w[1:] / deviation]


def dictionary(size: int, samples: list[bytes], k: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few or too alike to train on."""
    try:
        made = zstandard.train_dictionary(size, samples, k=k, d=8).as_bytes()
    except zstandard.ZstdError:
        made = b""
    return made if 2 * len(made) >= size else (made + b"".join(dict.fromkeys(samples)))[-size:]


def train_pair(ordinary: list[list[bytes]], toxic: list[list[bytes]], s: Settings, seed: int) -> tuple[bytes, bytes, bytes]:
    """(ordinary, toxic, shared) from the pieces of each class's documents. ``seed`` deals the documents to halves."""
    rng = np.random.default_rng(seed)
    deal = lambda texts: [[texts[k] for k in half] for half in (lambda o: (o[::2], o[1::2]))(rng.permutation(len(texts)))]
    (first, second), halves = deal(ordinary), deal(toxic)
    cut = lambda texts, size: [w for pieces in texts for p in pieces for w in windows(p, size)]
    shared = dictionary(s.shared_bytes, cut(first, s.piece), 64)
    plain = compressor(shared)
    cost = lambda w: len(plain(w)) / len(w)
    fresh = cut(second, 48)
    costs = np.array([cost(w) for w in fresh])
    bar = np.quantile(costs, s.hard) if len(costs) else 0.0
    usual = [w for w, c in zip(fresh, costs) if c >= bar]
    hard = [[w for w in cut(half, 48) if cost(w) >= bar] for half in halves]
    known = compressor(dictionary(2 * s.class_bytes, usual, 24) + shared)
    tests, found = cut(first[: max(1, len(first) // 4)], 32), []
    for half, other in ((0, 1), (1, 0)):
        trial = compressor(dictionary(2 * s.class_bytes, hard[other], 24) + shared)
        gain = lambda w: len(known(w)) - len(trial(w))  # noqa: E731, B023
        least = max(1, np.quantile([gain(w) for w in tests], s.telling)) if tests else 1
        found += [w for w in cut(halves[half], 32) if gain(w) > least]
    if len(found) < 100:  # too few documents for a second round
        found = hard[0] + hard[1]
    return dictionary(s.class_bytes, usual, 24), dictionary(s.class_bytes, found, 24), shared


def train_dictionaries(rows: list[tuple[int, int, list[bytes]]], s: Settings) -> Model | None:
    """Rows: (doc_id, label, pieces). None without both classes."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    ordinary, toxic = ([r[2] for r in rows if r[1] == label] for label in (0, 1))
    if not any(ordinary) or not any(toxic):
        return None
    return Model([train_pair(ordinary, toxic, s, seed) for seed in range(s.committee)], np.zeros(FEATURES + 1), s)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, rate: float) -> None:
    """``rate``: the share of toxic ones among all rows that may be learned from, where the sample has another."""
    model.coefficients = logistic(x, y)
    rate = min(max(rate, 0.001), 0.999)
    model.coefficients[0] += np.log(rate / (1 - rate)) - np.log(y.sum() / (len(y) - y.sum()))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Three of four sampled documents go into the dictionaries, the others are scored whole for the calibration.

    With fewer than 20 toxic ones for that, it takes all of them.
    """
    sample = durable(labelled_sample(docs, labels, "toxic", s.divisor, s.held, s.per_class)).withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 3)

    def shorten(batch):
        ids = batch.column("doc_id").to_pylist()
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "pieces": [drawn(encoded(t), k % (1 << 32), s) for k, t in zip(ids, batch.column("text").to_pylist())]}

    found = arrow_map(sample.filter("not test").drop("test"), shorten, "doc_id long, label int, pieces array<binary>").collect()
    model = train_dictionaries([(r.doc_id, r.label, [bytes(p) for p in r.pieces]) for r in found], s)
    if model is None:
        return Model([], np.r_[-35.0, np.zeros(FEATURES)], s)
    packed = pickle.dumps(model)

    def measure(batch, held=[]):  # noqa: B006  one model a worker
        held or held.append(pickle.loads(packed))
        return {"label": batch.column("label"), "x": [held[0].features(encoded(t)).tolist() for t in batch.column("text").to_pylist()]}

    tests = sample.filter("test")
    if tests.filter("label = 1").count() < 20 or tests.filter("label = 0").count() < 20:
        tests = sample
    seen = arrow_map(tests.select("label", "text"), measure, "label int, x array<double>").collect()
    rate = labels.filter(id_remainder("doc_id", s.divisor) != s.held).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    calibrate(model, np.array([r.x for r in seen]), np.array([float(r.label) for r in seen]), 0.5 if rate is None else rate)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    packed = pickle.dumps(model)

    def run(batch, held=[]):  # noqa: B006  one model a worker
        held or held.append(pickle.loads(packed))
        return {"doc_id": batch.column("doc_id"), "score": held[0].score(map(encoded, batch.column("text").to_pylist()))}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels, s))
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", s.divisor) == s.held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns unchanged; nothing is shuffled."""
    import pyarrow as pa

    packed = pickle.dumps(model)

    def run(batches):
        held = pickle.loads(packed)
        for batch in few_rows(batches):
            yield batch.filter(pa.array(held.score(map(encoded, batch.column("text").to_pylist())) < held.s.threshold))

    return arrow_rows(docs, run, docs.schema)
