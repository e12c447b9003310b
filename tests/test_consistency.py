from tideline.plans.queries import QUERIES


def test_inconsistent_actuals_count_their_rows(spark, monkeypatch):
    rows = [("m", "a", 1, "5", 5, 2.0), ("n", "a", 1, "5", 5, 2.5), ("o", "a", 1, "5", 5, 2.0), ("m", "a", 1, "4", 4, 3.0), ("n", "a", 1, "4", 4, 3.0)]
    panel = spark.createDataFrame(rows, "model string, variable string, horizon int, forecast_origin string, origin_ord long, actual double")
    monkeypatch.setattr("tideline.plans.datasets.panel", lambda *_: panel)
    assert [tuple(r) for r in QUERIES["realisation_consistency"](spark, "").collect()] == [("a", 1, "5", 0.5, 3)]


def test_held_tables_are_released(spark):
    from tideline.functions import tables

    made = [tables.hold(spark.range(k + 1).toDF(f"c{k}")) for k in range(7)]
    assert [df.is_cached for df in made] == [False] * 3 + [True] * 4 and [df.count() for df in made] == list(range(1, 8))
    for _ in range(4):
        tables._HELD.pop()[1].unpersist()
