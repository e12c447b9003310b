import numpy as np

from tideline.llm import embdedup
from tideline.llm.queries import QUERIES


def brute(rows, threshold=0.98):
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    good = [v is not None and len(v) > 0 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, label in rows]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), links[i], str(least.get(root(i)))) for i in range(n))


def clustered(rng, groups, each, dim):
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for _ in range(each):
            rows.append((len(rows) + 3, (base + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.1, 0.16])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
    return rows


def test_links_against_brute_force_in_one_block_and_many(spark):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 6, 30, 32) + clustered(rng, 60, 1, 32)
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    for block in (1500, 7):
        got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embdedup.duplicates(df, block=block).collect())
        missed = sum(w[1] for w in want) - sum(g[1] for g in got)
        assert 0 <= missed <= 0.01 * sum(w[1] for w in want), block
        assert np.mean([g == w for g, w in zip(got, want)]) > 0.97


def test_awkward_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(5, one, 1), (4, [2.0, 4.0, 6.0], 1), (6, one, 1), (6, one, 1), (7, one, 2), (8, one, None), (9, None, 1), (10, [], 1), (11, [0.0, 0.0, 0.0], 1), (12, [None, 2.0, 3.0], 1), (13, [float("inf"), 2.0, 3.0], 1), (None, one, 1), (None, one, 3), (14, [1.0, 2.0], 1), (15, [1e200, 2e200, 3e200], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, component_id string")
    got = embdedup.duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == sorted([("5", 5, "4"), ("4", 5, "4"), ("6", 5, "4"), ("6", 5, "4"), ("7", 0, "7"), ("8", 0, "8"), ("9", 0, "9"), ("10", 0, "10"), ("11", 0, "11"), ("12", 0, "12"), ("13", 0, "13"), ("None", 5, "4"), ("None", 0, "None"), ("14", 0, "14"), ("15", 5, "4")])
    assert sorted(str(r.vec_id) for r in got if r.kept) == sorted(["4", "7", "8", "9", "10", "11", "12", "13", "14"])
    assert embdedup.duplicates(df.filter("false")).count() == 0
    assert embdedup.duplicates(df.filter("vec_id = 9")).count() == 1


def test_rotation_is_orthogonal_and_codes_are_balanced():
    x = embdedup.units(np.random.default_rng(1).standard_normal((2000, 24)) @ np.diag(np.linspace(0.2, 2, 24)))
    centre, r = embdedup.learn_rotation(x)
    assert np.allclose(r.T @ r, np.eye(24), atol=1e-8)
    assert np.abs(((x - centre) @ r >= 0).mean(axis=0) - 0.5).max() < 0.1


def test_query_recall_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in QUERIES["op3_itq_dedup"](spark, sf).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_links_equal_sql(spark, tmp_path):
    """The query and its SQL over a table with groups of near copies, chains, copies and awkward rows."""
    import duckdb

    from tideline.llm.queries import ORACLE_SQL

    rng, rows = np.random.default_rng(21), []
    for g in range(40):
        at = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 25))):
            at = at + rng.standard_normal(64) * rng.choice([0, 0.02, 0.06])  # chains of near copies
            rows.append((at.tolist(), g % 3))
    rows += [(None, 1), ([], 1), ([0.0] * 64, 1), ([float("nan")] * 64, 2), (rows[0][0], None), (rows[0][0], 0), (rows[0][0][:5], 0), ([None] + rows[1][0][1:], 0)]
    df = spark.createDataFrame([(3 * i + 1, v, label) for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    df.coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(ORACLE_SQL["op3_itq_dedup"]).fetchall()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op3_itq_dedup"](spark, str(tmp_path)).collect()}
    assert got == want and sum(n for n, _, _ in want.values()) > 1000
