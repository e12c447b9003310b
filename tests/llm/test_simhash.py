import random

import numpy as np
import xxhash

from tideline.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (doc_id, fp)."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(d)
    return {d: min(x for x in g if x is not None) if any(x is not None for x in g) else None for g in groups.values() for d in g}


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 40, 700):
        text = " ".join(rng.choice(["Ab", "cé", "dd\n", "E\t", "Éf", "g h", " "]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(5)
    unsigned = [m & (1 << 64) - 1 for m in simhash.FIRST]
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not x & m for m in unsigned)
        t = next(k for k, m in enumerate(unsigned) if not x & m)
        assert any(not x & (m & (1 << 64) - 1) for m in simhash.SECOND[t])


def test_links_in_keeps_components():
    rng = np.random.default_rng(1)
    fps = np.array([int(rng.integers(1 << 63)) ^ 0 for _ in range(5)], np.uint64)
    fps = np.array([int(f) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for f in fps for _ in range(30)], np.uint64)
    nodes = rng.permutation(len(fps)).astype(np.int64) + 10
    keys = np.sort(rng.integers(0, 3, len(fps)))
    a, b = simhash.links_in(keys, fps, nodes, 4)
    where = {n: i for i, n in enumerate(nodes)}
    groups = {}
    for x, y in zip(a, b):
        assert y < x and keys[where[x]] == keys[where[y]]
        groups[x] = y
    for k in range(3):
        rows = [(int(nodes[i]), int(fps[i])) for i in np.flatnonzero(keys == k)]
        want = brute_components(rows)
        assert {n: groups.get(n, n) for n, _ in rows} == want


def near(rng, fp, n):
    return fp ^ sum(1 << b for b in rng.sample(range(64), n))


def run(spark, prints, bucket):
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in prints]
    df = spark.createDataFrame(signed, "rep long, fp long")
    distinct = df.groupBy("fp").agg({"rep": "min"}).withColumnRenamed("min(rep)", "rep")
    found = simhash.connected_components(simhash.fingerprint_links(distinct, bucket))
    return {r.node: r.component for r in found.collect()}


def test_every_split_level_gives_brute_force_components(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints, seen = [], set()
    for b in base:
        at = b
        for _ in range(60):
            at = near(rng, b, rng.randint(0, 3)) if rng.random() < 0.7 else near(rng, at, rng.randint(1, 5))
            if at not in seen:
                seen.add(at)
                prints.append((len(prints) + 1, at))
    want = brute_components(prints)
    for bucket in (2000, 30, 3):
        got = run(spark, prints, bucket)
        assert {d: got.get(d, d) for d, _ in prints} == want, bucket


def test_awkward_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (7, "same words in here twice", "x"), (9, "same words in here twice", "y"), (9, "same words in here twice", "y"), (None, "other words are in this one", "z"), (11, "Other words\nare in  this one", "z"), (12, "long " * 50000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.clusters(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[5] == by[3] == 3 and by[9] == by[7] == 7 and by[11] == 11 and by[None] == 11
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "12", "3", "7", "None"]
    two = spark.createDataFrame([(1, "one two three four five", {"a": 1}, 1), (1, "quite other words stand here", {"a": 2}, 2), (2, "one two three four five", {"a": 3}, 3), (2, "one two three four five", {"a": 3}, 3), (3, "a third text of its own", {"a": 4}, 4), (3, "a third text of its own", {"a": 4}, 4), (0, "quite other words stand here", {"a": 5}, 5)], "doc_id int, text string, _n map<string,int>, _keep int")
    kept = simhash.deduplicate(two)
    assert kept.dtypes == two.dtypes and sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "quite other words stand here"), (1, "one two three four five"), (3, "a third text of its own")]
    apart = two.filter("_keep in (1, 2)")
    assert sorted(r.text for r in simhash.deduplicate(apart.toDF("doc_id", "text", "row", "fp")).collect()) == ["one two three four five", "quite other words stand here"]
    empty = docs.filter("false")
    assert simhash.clusters(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_query_equals_brute_force_on_a_table(spark):
    from tideline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, sf).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in prints}
