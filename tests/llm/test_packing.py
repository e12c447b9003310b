import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tideline.llm import packing as P
from tideline.llm.queries import QUERIES


def check(rows, texts, size):
    """Every id in exactly one piece, sequences gapless and within ``size``; returns the padded share."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(map(str, by_doc)) == sorted(set(map(str, texts)))
    for d, found in by_doc.items():
        ids = np.array([*tok.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        found.sort(key=lambda r: r.start)
        assert [r.start for r in found] == [0, *np.cumsum([r.length for r in found])[:-1]]
        assert sum(r.length for r in found) == len(ids) and all(r.doc_tokens == len(ids) for r in found)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in found)
    for found in by_sequence.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [0, *np.cumsum([r.length for r in found])[:-1]]
        assert sum(r.length for r in found) <= size
    used = sum(r.length for r in rows)
    return 1 - used / (size * len(by_sequence))


def test_patterns_use_every_piece_once():
    rng = random.Random(2)
    for _ in range(30):
        size = rng.choice([8, 64, 2048])
        histogram = Counter(min(size, max(1, int(rng.paretovariate(0.7)))) for _ in range(rng.choice([1, 5, 400])))
        made = P.patterns(histogram, size)
        used = Counter()
        for count, parts in made:
            assert sum(a * k for a, k in parts) <= size
            for a, k in parts:
                used[a] += k * count
        assert used == histogram
        ranks = defaultdict(list)
        for length, first, last, *_ in P.slots(made):
            ranks[length] += range(first, last + 1)
        assert all(sorted(ranks[a]) == list(range(n)) for a, n in histogram.items())
    assert P.patterns({}) == [] and P.slots([]) == []


def test_ids_equal_the_tokenizer_file():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = P.encoder()
    for t in ["", " ", "a  b   c\n\n d\t\te ", "it's I'LL x y", "日本語 テキスト", "<|endoftext|> x", "naïve Ünïcode 123,456", "\x1c\x1f\x85 q", "a" * 5000, "\r\n\r\n \n x", "　  z", "éͅ x"]:
        assert e.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some text", "x"), (4, "word " * 30000, "x"), (5, "a b c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    check(P.pack(docs, 64).collect(), {r[0]: r[1] for r in rows}, 64)
    twice = P.pack(docs.union(docs)).collect()
    assert len(twice) == 2 * len(P.pack(docs).collect())
    assert P.pack(docs.filter("false")).count() == 0


def test_query_packs_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(QUERIES["op6_packing"](spark, sf).collect(), texts, 2048) < 0.02


def test_ids_of_a_whole_table_equal_the_tokenizer_file():
    """Every text of a table, by the encoder with its fast library and by the file alone."""
    import pyarrow.parquet as pq

    tok, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.encoder()
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    fast = 0
    for t in texts:
        assert e.ids(t).tolist() == tok.encode(t or "", add_special_tokens=False).ids
        fast += not e.odd.search(t or "")
    assert 0 < fast < len(texts) or fast == len(texts)


def test_full_pieces_and_many_rank_groups(spark):
    rows = [(i % 7, "word " * (3 * i)) for i in range(120)] + [(None, "word " * 500)] * 3
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, sequence_id int, rank int").repartition(3)
    got = P.pack(docs, 64, group=5).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert sum(r.length for r in got) == sum(len(P.encoder().ids(t)) + 1 for _, t in rows)
    for found in by.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [0, *np.cumsum([r.length for r in found])[:-1]] and sum(r.length for r in found) <= 64
        assert len(found) == 1 or all(r.length < 64 for r in found)
    assert sum(len(f) == 1 and f[0].length == 64 for f in by.values()) > 50
    assert 1 - sum(r.length for r in got) / (64 * len(by)) < 0.03
