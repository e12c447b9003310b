import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import periods, scalars
from tideline.operators import checks, vintage
from tideline.plans import planning, runstate
from tideline.schemas import DataError
from tideline.sources import panels
from tideline.streaming import revisions


def test_splits_on_the_boundary(spark):
    c = spark.createDataFrame([(20,)], "cutoff int")
    s = planning.validation_splits(c, {1: 1, 4: 4}, min_train=15, n_splits=3).orderBy("origin").collect()
    assert [r.origin for r in s] == [14, 15, 16] and s[0].train_start == 0 and s[0].targets == {1: 15, 4: 18}
    with pytest.raises(Exception, match="too few splits"):
        planning.validation_splits(c, {1: 1, 4: 4}, min_train=16, n_splits=3).collect()
    rolling = planning.validation_splits(c, {1: 1}, 5, 2, window=5, decay=0.5).orderBy("origin").collect()
    assert [(r.train_start, r.train_end) for r in rolling] == [(14, 18), (15, 19)] and sum(r.origin_weight for r in rolling) == pytest.approx(1)
    assert checks.leaking_splits(planning.validation_splits(c, {1: 1, 4: 4}, 15, 3)).count() == 0
    bad = planning.validation_splits(c, {1: 1, 4: 4}, 15, 3).withColumn("info_cutoff", F.lit(17))
    assert checks.leaking_splits(bad).count() == 3  # targets at 18, 19 and 20


def test_plans_partition_the_targets(spark):
    v, h = spark.createDataFrame([("Real GDP",), ("CPI",)], "variable string"), spark.createDataFrame([(1,), (4,)], "horizon int")
    t = planning.targets(v, h)
    plan = planning.selection_plan(t, planning.SCOPES, {"Prices": ["CPI"]})
    assert {r.scope: r.n for r in plan.groupBy("scope").agg(F.countDistinct("cell_id").alias("n")).collect()} == {"pooled": 1, "horizon": 2, "variable": 2, "variable_horizon": 4, "group": 2, "group_horizon": 4}
    assert "variable-real-gdp-h4" in {r.cell_id for r in plan.collect()}
    assert checks.partition_faults(plan.filter("scope = 'variable'"), t).count() == 0
    assert checks.partition_faults(plan.filter("cell_id = 'variable-cpi'"), t).count() == 2
    with pytest.raises(ValueError):
        planning.grouped_variables(v, {"a": ["CPI"], "b": ["CPI"]})
    with pytest.raises(DataError):
        planning.selection_plan(t, ("nothing",))


def test_events(spark):
    o = spark.createDataFrame([(i, 100 + i) for i in range(7)], "idx int, origin int")
    spans = lambda **k: [(r.applies_from, r.applies_to) for r in planning.selection_events(o, **k).orderBy("applies_from").collect()]
    assert spans() == [(0, 6)] and spans(every=3) == [(0, 2), (3, 5), (6, 6)] and spans(explicit=[0, 5]) == [(0, 4), (5, 6)]
    with pytest.raises(DataError):
        planning.selection_events(o, explicit=[2])
    assert planning.event_of_origin(o, planning.selection_events(o, 3)).count() == 7
    assert planning.grid(spark).count() == 108
    assert planning.fit_counts(4, 12, 8, 4, 8) == {"per_cell": 4 * 12 * 8 * 4 + 96, "shared": 4 * 8 * 4 + 96}


def test_periods(spark):
    row = spark.sql("select date'2020-11-15' d").select(
        periods.quarter_label(periods.target_quarter(periods.quarter_ordinal(F.col("d")), F.lit(1))).alias("a"), periods.quarter_label(periods.target_quarter(periods.quarter_ordinal(F.col("d")), F.lit(2))).alias("b"),
        periods.quarter_end(F.col("d")).cast("string").alias("c"), periods.origin_group(F.month("d")).alias("g"), periods.month_start(periods.month_ordinal(F.col("d"))).cast("string").alias("m"), periods.required_months(periods.month_ordinal(F.col("d")), F.lit(1)).alias("r"),
    ).first()
    assert tuple(row) == ("2020Q4", "2021Q1", "2020-12-31", "+1 month", "2020-11-01", 1)


def test_scalars(spark):
    df = spark.createDataFrame([("LinAlgError: Singular",), ("TimeoutError",), ("x",), (None,), ("KeyboardInterrupt",), ("OutOfMemory",)], "e string")
    assert [r[0] for r in df.select(scalars.failure_class(F.col("e"))).collect()] == ["numerical", "timeout", "runtime", "unknown", "cancelled", "runtime"]
    with pytest.raises(Exception, match="unknown transform"):
        spark.sql("select 1D x, 'sqrt' k").select(scalars.transform(F.col("x"), F.col("k"))).collect()
    t = spark.sql("select 0.3D x").select(scalars.to_box(scalars.to_unbounded(F.col("x"), F.lit(0.0), F.lit(2.0)), F.lit(0.0), F.lit(2.0)).alias("y")).first().y
    assert t == pytest.approx(0.3)
    assert scalars.stable_hash({"b": 1, "a": 2}) == scalars.stable_hash({"a": 2, "b": 1}) and scalars.child_seed(1, "a") != scalars.child_seed(1, "b")
    os.environ["TIDELINE_X"] = "v"
    assert scalars.expand_environment({"a": ["${TIDELINE_X}", "${TIDELINE_NONE:-d}"]}) == {"a": ["v", "d"]}
    assert scalars.human_size(1536) == "1.5 KiB"


def levels(spark, rows):
    return spark.createDataFrame(rows, "series_id string, period int, value double")


def test_windows(spark):
    full = [(s, p, 1.0) for s in "ab" for p in range(5)]
    assert vintage.complete_window(levels(spark, [r for r in full if r[:2] != ("a", 0)]), 2).count() == 8
    with pytest.raises(Exception, match="gap"):
        vintage.complete_window(levels(spark, [r for r in full if r[:2] != ("a", 2)]), 2).collect()
    with pytest.raises(Exception, match="starts late"):
        vintage.complete_window(levels(spark, [r for r in full if r[:2] != ("a", 0)]), 2, start=0).collect()
    ragged = levels(spark, [r for r in full if r[:2] != ("a", 4)])
    assert vintage.ragged_window(ragged, 2).count() == 9
    with pytest.raises(Exception, match="gap inside"):
        vintage.ragged_window(levels(spark, [(s, p, None if (s, p) == ("a", 2) else v) for s, p, v in full]), 2).collect()
    with pytest.raises(Exception, match="not positive"):
        vintage.growth(levels(spark, [("a", 0, 1.0), ("a", 1, 0.0)]), ["series_id"], "period").collect()


def test_backcast_holds_where_growth_is_unknown(spark):
    have = levels(spark, [("a", 3, 10.0), ("a", 4, 11.0)])
    reference = levels(spark, [("a", 0, 4.0), ("a", 1, 0.0), ("a", 2, 2.0), ("a", 3, 4.0)])
    got = {r.period: r.value for r in vintage.backcast(have, reference).collect()}
    assert got == {3: 10, 4: 11, 2: pytest.approx(5), 1: pytest.approx(5), 0: pytest.approx(5)}


def test_vintage_violations(spark):
    import datetime as dt

    d = dt.date
    rows = [("a", d(2020, 2, 1), d(2020, 1, 1), 1.0), ("a", d(2020, 2, 1), d(2020, 3, 1), 1.0), ("a", d(2020, 2, 1), d(2020, 1, 1), 1.0), ("b", d(2020, 2, 1), d(2020, 1, 1), None)]
    p = spark.createDataFrame(rows, "series_id string, vintage_date date, observation_date date, value double")
    got = {r.series_id: tuple(r)[1:] for r in checks.vintage_violations(p).collect()}
    assert got == {"a": (3, 0, 1, 1), "b": (1, 1, 0, 0)}
    with pytest.raises(DataError):
        vintage.assert_point_in_time(p)


def test_sources_round_trip(spark, tmp_path):
    raw = "strategy,forecast_origin,group,target_quarter,horizon_quarters,variable,forecast_method,actual_metric,mean_metric,error_metric\n" + "".join(f"s,{o},all,{o + 1},1,y,iterated,1.0,{1 + o / 10},\n" for o in (9, 99, 100))
    for name in ("m1", "m2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "forecast_panel.csv").write_text(raw)
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"baseline_model": "m1", "panels": [{"model": m, "family": "f", "scope": "pooled", "selection": "once", "forecast_method": "iterated", "size": None, "dir": m} for m in ("m1", "m2")]}))
    got = panels.study(spark, str(manifest), str(tmp_path))
    assert got.count() == 6 and [r.origin_ord for r in got.filter("model = 'm1'").orderBy("origin_ord").collect()] == [9, 99, 100]
    assert got.filter("forecast_origin = '9'").first().error == pytest.approx(0.9)
    assert {r.run for r in panels.runs(spark, str(tmp_path)).collect()} == {"m1", "m2"}
    (tmp_path / "m2" / "forecast_panel.csv").write_text(raw + "s,9,all,10,1,y,iterated,1.0,1.2,\n")
    with pytest.raises(DataError, match="repeated keys"):
        panels.study(spark, str(manifest), str(tmp_path))
    (tmp_path / "m2" / "forecast_panel.csv").write_text(raw.replace("1.0,", "3.0,"))
    with pytest.raises(DataError, match="realisations differ"):
        panels.study(spark, str(manifest), str(tmp_path))
    (tmp_path / "m2" / "forecast_panel.csv").write_text(raw.split("\n")[0] + "\n")
    with pytest.raises(DataError, match="no rows"):
        panels.study(spark, str(manifest), str(tmp_path))


def test_csv_panels_and_sinks(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,a,b\n2020-01-31,1,NaN\n2020-02-29,2,x\n")
    w = panels.wide_csv(spark, str(tmp_path / "w.csv"), ["a", "b"], "date").orderBy("row_idx").collect()
    assert [(r.row_idx, r.a, r.b) for r in w] == [(0, 1, None), (1, 2, None)]
    with pytest.raises(DataError):
        panels.wide_csv(spark, str(tmp_path / "w.csv"), ["c"])
    lines = spark.createDataFrame([("2020-01-01,1.5",), ("bad,1",), ("2020-01-02,.",)], "value string")
    assert [tuple(map(str, r)) for r in panels.two_column_text(lines).collect()] == [("2020-01-01", "1.5")]
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    panels.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert "| a | 1.0000 |" in panels.markdown(df, "T") and r"a & 1.0000 \\" in panels.latex(df)
    with pytest.raises(DataError):
        panels.markdown(df, "T", 1)


def test_run_states(tmp_path):
    f = tmp_path / "run"
    assert runstate.state(f) == "missing"
    assert runstate.prepare(f, "h1") == "run" and runstate.state(f) == "partial"
    with pytest.raises(runstate.RunStateError):
        runstate.prepare(f, "h1")
    runstate.finish(f, "failed", error="x")
    assert runstate.state(f) == "failed" and runstate.prepare(f, "h1", "resume") == "run"
    with pytest.raises(runstate.RunStateError):
        runstate.finish(f, outputs=("out.csv",))
    (f / "out.csv").write_text("x")
    runstate.finish(f, outputs=("out.csv",))
    assert runstate.state(f, ("out.csv",)) == "complete" and runstate.prepare(f, "h1", "resume", ("out.csv",)) == "skip"
    with pytest.raises(runstate.RunStateError):
        runstate.prepare(f, "h2", "resume")
    assert runstate.prepare(f, "h2", "overwrite") == "run"
    plan = runstate.plan_jobs([{"job_id": "a"}, {"job_id": "b"}, {"job_id": "c", "needs": ["b"]}], {"a": "complete", "b": "failed"})
    assert [p["action"] for p in plan] == ["skip", "resume", "skip_missing_dep"]


def test_stream_of_revisions_equals_the_batch(spark, tmp_path):
    import datetime as dt

    rng = np.random.default_rng(1)
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=30 * int(v)), dt.date(2019, 12, 1) + dt.timedelta(days=30 * int(o)), float(rng.normal())) for v in range(6) for o in range(v + 1)]
    df = spark.createDataFrame(rows, "series_id string, vintage_date date, observation_date date, value double")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    q = revisions.newest(revisions.vintage_stream(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.observation_date, r.value) for r in spark.table("newest").collect())
    assert got == sorted((r.observation_date, r.value) for r in vintage.latest(df).collect())


def test_cache_reads_through_and_notices_changes(spark, tmp_path):
    from tideline.sources import cache

    path, built = str(tmp_path / "c"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")

    assert cache.read_through(spark, path, "s", build).count() == 2
    assert cache.read_through(spark, path, "s", build).count() == 2 and len(built) == 1
    with pytest.raises(DataError, match="not t"):
        cache.read_through(spark, path, "t", build)
    spark.createDataFrame([("a", 2.0)], "k string, v double").write.mode("overwrite").parquet(path + "/data")
    with pytest.raises(DataError, match="changed"):
        cache.read_through(spark, path, "s", build)
    assert cache.read_through(spark, path, "s", build, refresh=True).count() == 2
    parts = [spark.createDataFrame([(s, k) for k in range(3)], "series_id string, k int") for s in "ba"]
    assert cache.assemble(parts, ["series_id", "k"]).count() == 6


def test_outputs_schedules_and_manifests(tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.json").write_text('{"k": 1}')
    assert runstate.validate_outputs(tmp_path, {"a.csv": (["x"], 1)}, {"b.json": ["k"]}) == []
    assert len(runstate.validate_outputs(tmp_path, {"a.csv": (["z"], 2), "n.csv": ([], 0)}, {"b.json": ["q"], "c.json": []})) == 5
    assert [planning.parse_schedule(t) for t in ("once", "per_origin", "annual", "3")] == [None, 1, 4, 3]
    with pytest.raises(DataError):
        planning.parse_schedule("0")
    assert planning.study_warnings(96, 3, 8) == [] and len(planning.study_warnings(5, 3, 2, True)) == 3
    made = json.loads(runstate.comparison_manifest(tmp_path, [tmp_path / "a.csv"], {"baseline": "m"}).read_text())
    assert made["inputs"][0]["bytes"] == 8 and len(made["inputs"][0]["sha256"]) == 64
    assert runstate.status_counts([{"state": "complete"}, {"state": "complete"}]) == {"complete": 2}


def test_report(spark, tmp_path):
    from tideline.plans import datasets, report

    tables = report.comparison(datasets.panel(spark, "/root/testdata/sf0.001").persist(), "no_change", draws=50)
    report.write({k: tables[k] for k in ("rmse", "average_ranks")}, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "rmse"), header=True).count() == 60
    assert "## average_ranks" in report.markdown(tables, ["average_ranks"])
    assert {r.table_name for r in report.overview(tables).collect()} == set(tables)
