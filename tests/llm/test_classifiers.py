import zlib

import numpy as np
import pytest

from tideline.llm import quality, toxicity
from tideline.llm.queries import QUERIES


def auc(score, label):
    score, label = np.array(score), np.array(label)
    return np.mean([(a > score[label == 0]).mean() + (a == score[label == 0]).mean() / 2 for a in score[label == 1]])


@pytest.mark.parametrize(("name", "target", "divisor", "held", "least"), [("op7_quality", "quality", 5, 0, 0.98), ("op4_toxicity", "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, name, target, divisor, held, least):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    if target == "toxic":  # in this table only English texts show what the label says, and 6 % of the toxic ones of these do not either
        english = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").select("doc_id").collect()}
        labels = {i: y for i, y in labels.items() if i in english}
    got = QUERIES[name](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    out = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert auc(*zip(*out)) > least
    wrong = np.mean([(s >= 0.3) != bool(y) for s, y in out])
    assert wrong < 0.05


@pytest.mark.parametrize(("module", "target"), [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, module, target):
    rows = [(i, ("fine words here now " if i % 2 else "bad!! ###idiot bad!! ") * 30, "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (None, "fine words", "x"), (1, "fine words here now " * 30, "x"), (62, "word " * 300000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = module.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score is not None and r.held_out is not None for r in got)
    ones = [r.score for r in got if r.doc_id == 1]
    assert ones[0] == ones[1]
    fitted = module.fit(docs, labels)
    kept = module.accepted(docs, fitted)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(rows)
    assert module.classify(docs.filter("false"), labels).count() == 0
    none = module.classify(docs, labels.filter("false")).collect()
    assert {r.score for r in none} == ({0.5} if module is quality else {min(r.score for r in none)})


def test_a_long_text_scores_as_in_one_piece():
    s = quality.Settings()
    weights = np.random.default_rng(1).standard_normal((1 << s.bits) + 1).astype(np.float32)
    text = "some words, repeated words words ### and more " * 60000
    from tideline.llm import bytehash

    _, _, h = bytehash.tokens(np.frombuffer(text.encode(), np.uint8))
    both = np.concatenate((h, bytehash.pairs(h))) >> np.uint64(64 - s.bits)
    index, counts = np.unique(both, return_counts=True)
    want = 1 / (1 + np.exp(-(weights[index.astype(np.int64)].astype(float) @ np.sqrt(counts) / np.sqrt(counts.sum()) + weights[-1])))
    assert abs(quality.score_texts([text, "x"], weights, s.bits)[0] - want) < 1e-9
    assert abs(quality.score_texts([text[:2000], "x y"], weights, s.bits)[0] - quality.score_texts([text[:2000]], weights, s.bits)[0]) < 1e-9


def test_only_training_rows_are_learned_from(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    from tideline.llm.common import labelled_sample

    got = labelled_sample(docs, labels, "quality", 5, 0, 30).collect()
    assert len(got) == 60 and all(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.label == r.doc_id % 2 for r in got)


def test_every_piece_of_a_text_may_be_drawn():
    """Pieces come from the whole of a text, however long, and a text of few pieces is taken whole."""
    s = toxicity.Settings()
    raw = b"".join(b"%06d " % k for k in range(60_000))
    found = toxicity.drawn(raw, 5, s)
    places = [raw.index(p) for p in found]
    assert len(found) == s.pieces and places == sorted(places) and min(places) < 0.1 * len(raw) and max(places) > 0.9 * len(raw)
    assert b"".join(toxicity.drawn(raw[:5000], 5, s)) == raw[:5000]


def test_toxicity_scores_by_definition(spark):
    """The scores of a table against the definition, window by window, from the dictionaries alone."""
    import math

    import zstandard

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert len(model.pairs) == model.s.committee and all(o != t and shared for o, t, shared in model.pairs)

    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=toxicity.SEARCH).compress(window))

    def brute(text):
        raw = (text or "").lower().encode("utf-8", "surrogatepass")
        parts = list(toxicity.windows(raw, 200))
        assert b"".join(parts) == raw and all(len(p) <= 200 for p in parts)
        rows = []
        for ordinary, toxic, shared in model.pairs:
            d = [size(w, ordinary + shared) - size(w, toxic + shared) for w in parts] or [0]
            n, share = len(d), lambda f: math.sqrt(sum(map(f, d)) / len(d)) if parts else 0.0  # noqa: B023
            rows.append([sum(d) / math.sqrt(n), sum(d) / n, min(max(d), 12), *(share(lambda x, t=t: x >= t) for t in (2, 3, 4, 6)), share(lambda x: x <= -3), math.log1p(len(raw))])
        z = model.coefficients[0] + sum(c * sum(r[k] for r in rows) / len(rows) for k, c in enumerate(model.coefficients[1:]))
        return 1 / (1 + math.exp(-z))

    few = docs.orderBy("doc_id").limit(40)
    got = {r.doc_id: r.score for r in toxicity.score(few, model).collect()}
    for r in few.collect():
        assert abs(got[r.doc_id] - brute(r.text)) < 1e-6


def test_quality_training_and_scores_by_definition(spark):
    """Follow-the-regularised-leader written plainly with dictionaries, over the same sample in the same order."""
    import math

    from tideline.llm import bytehash

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    s = quality.Settings(bits=12, epochs=2)
    weights = quality.fit(docs, labels, s)
    texts = {r.doc_id: r.text for r in docs.collect()}
    chosen = sorted((r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 0)
    assert max(np.bincount([y for _, y in chosen])) <= s.per_class  # so the sample is all of them

    def features(text):
        _, _, h = bytehash.tokens(np.frombuffer((text or "").encode(), np.uint8))
        counts = {}
        for x in [*h.tolist(), *bytehash.pairs(h).tolist()]:
            counts[x >> 52] = counts.get(x >> 52, 0) + 1
        norm = math.sqrt(sum(counts.values())) or 1.0
        return {k: float(np.float32(math.sqrt(c) / norm)) for k, c in counts.items()} | {1 << 12: 1.0}

    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= s.l1:
            return 0.0
        return -(z[k] - math.copysign(s.l1, z[k])) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    data = [(features(texts[i]), y) for i, y in chosen]
    ones = sum(y for _, y in data)
    balance = [len(data) / (2 * (len(data) - ones)), len(data) / (2 * ones)]
    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in rng.permutation(len(data)):
            x, y = data[k]
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-sum(w[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = balance[y] * (p - y) * v
                z[j] = z.get(j, 0.0) + g - (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / s.alpha * w[j]
                n[j] = n.get(j, 0.0) + g * g
    want = np.array([weight(k) if k in z else 0.0 for k in range((1 << 12) + 1)])
    assert np.abs(want - weights).max() < 1e-4 and np.count_nonzero(want) > 100
    got = {r.doc_id: r.score for r in quality.score(docs, weights, s).collect()}
    for i, t in texts.items():
        assert abs(got[i] - 1 / (1 + math.exp(-sum(want[k] * v for k, v in features(t).items())))) < 1e-3


def test_quality_learns_the_same_in_parts(spark):
    """What features are too many for the driver at once come in the same order, a part at a time."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    assert np.array_equal(quality.fit(docs, labels), quality.fit(docs, labels, at_once=1 << 15))
