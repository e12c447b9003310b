import random

from tideline.llm import sentencepieces as S
from tideline.llm.queries import QUERIES


def brute(m, line):
    """Best path over the whole line at once."""
    n = len(line)
    best = [(0.0, ())] + [None] * n
    for end in range(1, n + 1):
        found = []
        for start in range(max(0, end - m.longest), end):
            if best[start] and line[start:end] in m.score:
                s, i = m.score[line[start:end]]
                found.append((best[start][0] + s, -start, best[start][1] + (i,)))
        c = line[end - 1]
        if c not in m.score:
            raw = (S.META if c == S.OWN else c).encode()
            found.append((best[end - 1][0] + m.unknown, -(end - 1), best[end - 1][1] + tuple(m.bytes[b] for b in raw)))
        top = max(found, key=lambda f: (f[0], f[1]))
        best[end] = (top[0], top[2])
    return list(best[n][1])


def meta(text):
    return (" " + text).replace(S.META, S.OWN).replace(" ", S.META)


TEXTS = ["a", "the cat  sat", "Ünïcode ▁ own meta ▁▁x", "tab\tand\nlines\n\n", "日本 語🙂 ok", "   lead", "trail   ", "x" * 700, "aab" * 400, "\x00\x1f", "é", "internationalisation" * 20]


def test_stream_equals_the_whole_search():
    m = S.model()
    rng = random.Random(4)
    for text in TEXTS + ["".join(rng.choice("abe nti▁ é\n") for _ in range(rng.randint(1, 300))) for _ in range(40)]:
        want = brute(m, meta(text))
        assert [i for run in m.stream(iter(meta(text))) for i in run] == want, text
        assert m.encode(text).tolist() == want, text
        assert m.decode(want) == text


def test_window_stays_bounded_where_paths_meet():
    m = S.model()
    seen = [len(run) for run in m.stream(iter(meta("some words of text " * 2000)))]
    assert len(seen) > 1000 and max(seen) < 200


def test_every_part_comes_from_the_stream(monkeypatch):
    m = S.Model(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    streamed, plain = [], m.stream
    monkeypatch.setattr(m, "stream", lambda chunks: plain(iter([streamed.append("".join(chunks)) or streamed[-1]])))
    text = "some words, some others 日本 and " + "x" * 300 + " some words"
    assert m.encode(text).tolist() == brute(m, meta(text))
    assert sorted(streamed) == sorted({meta(p)[1:] for p in m.part.findall(" " + text)})


def test_overlapping_paths_are_committed_where_back_pointers_meet():
    """A model whose pieces overlap without end, so that no boundary is ever reached by all paths at once."""
    m = S.Model.__new__(S.Model)
    m.pieces = ["a", "aa", "aaa", "ab", "ba"]
    m.score = {"a": (-1.0, 0), "aa": (-1.875, 1), "aaa": (-2.75, 2), "ab": (-1.5, 3), "ba": (-1.5, 4), "b": (-2.0, 5)}
    m.bytes, m.unknown, m.longest = {}, -30.0, 3
    m.trie = S.trie(m.score)
    rng = random.Random(9)
    for line in ["a" * 997, "ab" * 400 + "a", "".join(rng.choice("aab") for _ in range(1500))]:
        runs = list(m.stream(line[k : k + 7] for k in range(0, len(line), 7)))
        assert [i for r in runs for i in r] == brute(m, line)
    assert max(map(len, runs)) < 60  # in the periodic lines paths stay apart to the end


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "x"), (3, "word " * 40000, "x"), (4, "▁", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.round_trip(docs).collect()
    assert len(got) == 5 and all(r.exact for r in got) and [r.n_ids for r in got[:3]] == [0, 0, 0]
    back = S.decode(S.encode(docs)).collect()
    assert sorted((r.text for r in back)) == sorted(r[1] or "" for r in rows)
    assert S.round_trip(docs.filter("false")).count() == 0


def test_query_round_trips_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op8_sentencepiece"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.exact and len(r.ids) == r.n_ids for r in got)
