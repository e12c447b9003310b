import random

from pyspark.sql import functions as F

from tideline.llm import common
from tideline.llm.components import connected_components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


def test_components_with_hubs_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 5)
    rng = random.Random(3)
    edges = [(7, k) for k in range(100, 400)] + [(900, k) for k in range(350, 800)] + [(k, k + 1) for k in range(2000, 2040)] + [(rng.randint(3000, 3300), rng.randint(3000, 3300)) for _ in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([*edges, (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df.union(spark.createDataFrame([(None, 3)], "a long, b long"))).collect()}
    assert got == brute(edges)
    assert connected_components(df.filter("false")).count() == 0


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 3)
    many = spark.range(500).select((F.col("id") % 7 * F.when(F.col("id") < 300, 0).otherwise(1)).alias("k"), F.col("id").alias("x"))
    one = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    heavy = common.heavy_keys(many, ["k"], 500)
    assert heavy.count() and max(r["_parts"] for r in heavy.collect()) > 50
    for how in ("inner", "left"):
        got = sorted(map(str, common.spread_join(many, one, ["k"], heavy, how).collect()))
        assert got == sorted(map(str, many.join(one, ["k"], how).collect()))
    assert common.heavy_keys(many.limit(3), ["k"], 3) is None
