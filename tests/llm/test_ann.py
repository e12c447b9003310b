import numpy as np
from pyspark.sql import functions as F

from tideline.llm import ann
from tideline.llm.queries import QUERIES


def brute(rows, k, ask):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero([ask(int(a)) for a in ids]):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 40)) * rng.uniform(0.1, 9, (3000, 1)), rng.standard_normal((50, 40))
    codes = ann.Codes(40, 256, x[:500].mean(axis=0))
    packed, length, own = codes.encode(x)
    estimate, half = codes.estimate(codes.quantise(q), np.ascontiguousarray(packed.T), length, own, 3.0)
    error = np.abs(estimate - q @ x.T)
    assert (error <= half).mean() > 0.995 and error.mean() < half.mean()


def test_blocks_give_brute_force_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[100:160] = x[5]  # ties
    rows = [(i - 50, x[i].tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 20, lambda i: i % 20 == 0)
    for block, queries in ((8192, 2048), (100, 10)):
        got = as_dict(ann.nearest(df, F.col("vec_id") % 20 == 0, 20, block=block, query_block=queries))
        assert got.keys() == want.keys()
        assert np.mean([[a[0] for a in got[i]] == [a[0] for a in want[i]] for i in want]) > 0.98
        assert all(abs(a[1] - b[1]) < 1e-9 for i in want for a, b in zip(got[i], want[i]))


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, None, "a"), (40, [], "a"), (60, [0.0, 0.0], "a"), (80, [float("nan"), 1.0], "a"), (100, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (7, [2.0, 1.0], "a"), (7, [2.0, 1.0], "a"), (8, [1.0, 2.0, 3.0], "a"), (9, [2.0, 5.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = as_dict(ann.nearest(df, F.col("vec_id") % 20 == 0, 20))
    assert got == {0: [(7, 2.0), (7, 2.0), (9, 2.0)]}
    twice = spark.createDataFrame([(20, [1.0, 2.0], 1), (20, [3.0, 1.0], 2), (1, [1.0, 0.0], 3)], "vec_id long, embedding array<double>, v int")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(twice, F.col("vec_id") % 20 == 0).collect())
    assert found == [(20, 1, 20, 5.0), (20, 1, 20, 5.0), (20, 2, 1, 1.0), (20, 2, 1, 3.0)]
    assert ann.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_clashing_and_repeated_columns_and_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(700).tolist(), 1, b"x", 2, 0.5, "y") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, v int, code binary, row int, floor double, cb string")
    got, want = as_dict(ann.nearest(df, F.col("vec_id") % 20 == 0, 5)), brute([(r[0], r[1]) for r in rows], 5, lambda i: i % 20 == 0)
    assert {i: [a for a, _ in x] for i, x in got.items()} == {i: [a for a, _ in x] for i, x in want.items()}


def test_query_recall_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows, 20, lambda i: i % 20 == 0), as_dict(QUERIES["op1_rabitq"](spark, sf))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 20 for i in want])
    assert recall >= 0.99


def test_floors_are_lower_bounds_and_spare_reranking():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 64))
    rows = np.arange(6000)
    codes = ann.Codes(64, 256, x.mean(axis=0))
    packed, length, own = codes.encode(x)
    words = np.ascontiguousarray(packed.T)
    q = rows[:100]
    floor = ann.floors(q, x[q], rows[::2], x[::2], 20)
    s = x[q] @ x.T
    s[q, q] = -np.inf
    assert (floor <= np.sort(s, axis=1)[:, -20]).all()
    got = ann.search_block(codes, q, x[q], floor, rows, rows, x, words, length, own, 20, 3.5)
    none = ann.search_block(codes, q, x[q], np.full(100, -np.inf), rows, rows, x, words, length, own, 20, 3.5)
    assert all(np.array_equal(a, b) for a, b in zip(got[:3], none[:3])) and len(got[0]) == 2000
    assert got[3] < none[3] and got[3] < 0.25 * s.size
    want = np.argsort(-s, axis=1, kind="stable")[:, :20]
    assert np.mean([set(got[1][got[0] == i]) == set(want[i]) for i in range(100)]) == 1


def test_query_equals_sql(spark):
    """Brute force in SQL over the same table; scores equal to the last bit."""
    import duckdb

    from tideline.llm.queries import ORACLE_SQL

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL["op1_rabitq"]).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    got = QUERIES["op1_rabitq"](spark, sf).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert got[["query_id", "rank", "vec_id"]].equals(want[["query_id", "rank", "vec_id"]].astype(got[["query_id", "rank", "vec_id"]].dtypes)) and (got.score == want.score).all()
