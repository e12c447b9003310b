import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.kernels import bvar
from tideline.operators import checks, draws, pairing
from tideline.plans import planning, runstate, search
from tideline.plans.experiment import Study
from tideline.schemas import DataError
from tideline.sources import panels


def smoke(spark, steps=70):
    return panels.synthetic_panel(spark, steps)


def test_spaces():
    assert search.SearchSpace().names(3) == ["lam", "theta", "mu"]
    assert search.SearchSpace("full", fixed={"mu": 1.0}).names(2) == ["lam", "theta", "psi_0", "psi_1"]
    assert search.SearchSpace("custom", free=("lam",)).names(2) == ["lam"]
    space = search.SearchSpace("full", bounds={"lam": (0.1, 0.3)})
    points = space.candidates(2, 30, seed=4)
    assert points == space.candidates(2, 30, seed=4) != space.candidates(2, 30, seed=5) and len(points) == 30
    assert all(0.1 <= p["lam"] <= 0.3 and search.MULTIPLIERS[0] < p["psi_1"] < search.MULTIPLIERS[1] for p in points)
    for bad in (lambda: search.SearchSpace("wide"), lambda: search.SearchSpace("custom"), lambda: search.SearchSpace(fixed={"x": 1}), lambda: search.SearchSpace(bounds={"lam": (1, 1)}).candidates(1, 2), lambda: search.SearchSpace("custom", free=("lam",), fixed={"lam": 1.0}).candidates(1, 2)):
        with pytest.raises(DataError):
            bad()


def test_natural_vectors_follow_the_window():
    rng = np.random.default_rng(1)
    c = bvar.context(rng.standard_normal((50, 2)) * [1, 10], 2)
    point = {"lam": 0.3, "theta": 2.0, "mu": 0.5, "psi_0": 0.4, "psi_1": -0.2}
    v = search.natural(point, c)
    assert np.allclose(v[3:], c.scale * np.exp([0.4, -0.2])) and {k: pytest.approx(x) for k, x in search.named(v, c).items()} == point
    assert len(search.natural({"lam": 0.3}, c)) == 3
    for outside in (5.0, float("nan")):
        with pytest.raises(ValueError):
            search.natural({"psi_0": outside}, c)


def test_scope_search_by_loss(spark):
    panel = smoke(spark)
    study = Study(variables=("gdp", "inv", "cons"), horizons=(1, 2), scopes=("pooled", "variable"), n_outer=2, n_inner=2)
    space = search.SearchSpace("custom", free=("lam", "psi"), bounds={"psi": (-9.0, 1.0)})  # some candidates lie outside
    values, selections, out = search.scope_search(panel, study, space, 8, diagnostics=True)
    values, selections, out = values.collect(), selections.collect(), out.collect()
    assert len(values) == 4 * 8 and any(r.failed and r.loss == search.PENALTY and r.reason for r in values) and any(not r.failed for r in values)
    for s in selections:
        mine = [(r.loss, r.candidate) for r in values if (r.cutoff, r.scope, r.cell_id) == (s.cutoff, s.scope, s.cell_id)]
        assert (s.loss, s.candidate) == min(mine) and set(s.point) == {"lam", "psi_0", "psi_1", "psi_2"}
    assert len(out) == 2 * 4 * 6 and sum(r.is_canonical for r in out) == 2 * (6 + 6)
    # One loss against the kernel by hand: the pooled cell of the first cutoff.
    rows = {(r.row_idx, r.variable): r.value for r in panel.collect()}
    s = next(s for s in selections if s.scope == "pooled")
    errors = []
    for k in range(2):
        o = s.cutoff - 2 - k
        y = np.array([[rows[t, v] for v in study.variables] for t in range(o + 1)])
        c = bvar.context(y, 2)
        path = bvar.predictive(c, search.natural(s.point, c), 2, None)
        errors += [rows[o + h, v] - path[h - 1, j] for h in (1, 2) for j, v in enumerate(study.variables)]
    cells = np.array(errors).reshape(2, 6)
    assert s.loss == pytest.approx(np.sqrt((cells**2).mean(axis=0).mean()), rel=1e-9)


def test_scope_search_by_evidence_and_failure(spark):
    panel = smoke(spark)
    study = Study(variables=("gdp", "inv"), horizons=(1,), scopes=("pooled", "horizon"), n_outer=2, n_inner=2)
    values, selections, out = search.scope_search(panel, study, search.SearchSpace(), 6, by_evidence=True)
    losses = {(r.scope, r.candidate): r.loss for r in values.collect()}
    assert len({v for v in losses.values()}) == 6 and out.count() == 2 * 2 * 2
    picked = selections.collect()
    assert all(s.loss == min(losses.values()) for s in picked)
    none = search.SearchSpace("custom", free=("theta",), fixed={"psi": 8.0})
    with pytest.raises(Exception, match="no feasible candidate"):
        search.scope_search(panel, study, none, 3)[1].collect()


def test_generated_draws_are_shared_and_fail_as_rows(spark):
    panel = smoke(spark)
    calls = spark.sparkContext.accumulator(0)

    def generator(y, params, horizons, rng):
        calls.add(1)
        if params["scale"] < 0:
            raise ValueError("negative")
        return params["scale"] * rng.standard_normal((5, len(horizons), 2))

    tasks = spark.createDataFrame([("a", 60, {"scale": 1.0, "x": 0.0}), ("b", 60, {"x": 0.0, "scale": 1.0}), ("c", 60, {"scale": -1.0, "x": 0.0}), ("d", 61, {"scale": 1.0, "x": 0.0})], "task string, origin int, params map<string,double>")
    got = search.generated(panel, tasks, generator, ["gdp", "inv"], [1, 3]).collect()
    by = {}
    for r in got:
        by.setdefault(r.task, []).append((r.draw, r.variable, r.horizon, r.value, r.error))
    assert sorted(by["a"], key=str) == sorted(by["b"], key=str) != sorted(by["d"], key=str) and len(by["a"]) == 20
    assert len(by["c"]) == 1 and by["c"][0][4] == "ValueError: negative" and calls.value == 3


def test_paths_and_growth(spark):
    history = spark.createDataFrame([("x", 1, 100.0), ("x", 2, 110.0)], "variable string, period int, value double")
    ahead = spark.createDataFrame([(0, "x", 2, 1.0), (0, "x", 3, 121.0), (1, "x", 3, 110.0)], "draw int, variable string, period int, value double")
    paths = draws.stacked([("history", history), ("forecast", ahead)], ahead)
    assert sorted((r.draw, r.period, r.value, r.segment) for r in paths.collect()) == [(0, 1, 100.0, "history"), (0, 2, 110.0, "history"), (0, 3, 121.0, "forecast"), (1, 1, 100.0, "history"), (1, 2, 110.0, "history"), (1, 3, 110.0, "forecast")]
    got = {(r.period, r.kind): r for r in draws.path_summaries(paths, ["x"]).collect()}
    assert got[3, "metric"].mean == pytest.approx(50 * np.log(1.1)) and got[1, "metric"].mean is None and got[3, "level"].median == 115.5
    with pytest.raises(Exception, match="positive levels"):
        draws.path_growth(paths.withColumn("value", -F.col("value")), ["x"]).collect()


def write_run(folder, strategy, rows, **more):
    folder.mkdir(parents=True)
    (folder / "run_metadata.json").write_text(json.dumps({"strategy": strategy} | more))
    (folder / "forecast_panel.csv").write_text("forecast_origin,variable,error\n" + "".join(f"{o},x,{e}\n" for o, e in rows))


def test_runs_are_found_whole(spark, tmp_path):
    write_run(tmp_path / "one", "a", [(1, 0.5)])
    write_run(tmp_path / "many" / "h1q", "b", [(1, 0.1)])
    write_run(tmp_path / "many" / "h2q", "b", [(1, 0.2), (2, 0.3)])
    (tmp_path / "many" / "notes").mkdir()
    assert panels.run_folders(spark, f"{tmp_path}/one") == [f"{tmp_path}/one"]
    assert [p[-3:] for p in panels.run_folders(spark, f"{tmp_path}/many")] == ["h1q", "h2q"]
    rows = panels.run_frames(spark, {"a": f"{tmp_path}/one", "b": f"{tmp_path}/many"}).collect()
    assert sorted((r.model, str(r.optimization_horizon), r.forecast_origin) for r in rows) == [("a", "None", "1"), ("b", "h1q", "1"), ("b", "h2q", "1"), ("b", "h2q", "2")]
    with pytest.raises(DataError, match="holds 'a', not 'b'"):
        panels.run_frame(spark, f"{tmp_path}/one", "b")
    write_run(tmp_path / "head", "c", [])
    with pytest.raises(DataError, match="no rows"):
        panels.run_frame(spark, f"{tmp_path}/head", "c")
    (tmp_path / "many" / "h1q" / "run_metadata.json").unlink()
    with pytest.raises(DataError, match="h1q: run_metadata.json is missing"):
        panels.run_folders(spark, f"{tmp_path}/many")
    with pytest.raises(DataError, match="no run"):
        panels.run_folders(spark, f"{tmp_path}/many/notes")
    with pytest.raises(DataError, match="doesn't exist"):
        panels.run_folders(spark, f"{tmp_path}/none")


def test_studies_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), (None, 3.0), ("a", 1.0)], "cell_id string, loss double").repartition(3)
    panels.write_study(f"{tmp_path}/s", {"selections": df}, {"selections": ["cell_id"]}, {"strategy": "x"})
    lines = [x for f in sorted((tmp_path / "s" / "selections").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("cell_id")]
    assert lines == [",3.0", "a,1.0", "b,2.0"]
    assert json.loads(next((tmp_path / "s" / "run_metadata").glob("part-*")).read_text()) == {"strategy": "x"}
    with pytest.raises(DataError):
        panels.write_study(f"{tmp_path}/t", {"selections": df}, {"selections": ["nothing"]})
    (tmp_path / "h.csv").write_text("forecast_origin,cell_id,param_lam,psi\n5,pooled,0.1,[1]\n6,pooled,nan,\n")
    got = panels.hyperparameters(spark, f"{tmp_path}/h.csv").collect()
    assert [r.param_lam for r in got] == [0.1, None] and got[0].cell_id == "pooled" and got[0].psi == "[1]"


def test_audits_lookups_and_metadata(spark):
    rows = [("a", "v", 1, None, "1", "2", 1, 1.0, 0.5), ("b", "v", 1, None, "1", "2", 1, 1.0, 0.4), ("a", "v", 1, "g", "1", "2", 1, 1.0, 0.1)]
    panel = spark.createDataFrame(rows, "model string, variable string, horizon int, group string, forecast_origin string, target string, origin_ord long, actual double, error double")
    assert {(r.model, r.group): r.status for r in pairing.paired(panel, "b").collect()} == {("a", None): "common", ("b", None): "common", ("a", "g"): "missing_baseline_key"}
    assert pairing.paired_errors(panel, spark.createDataFrame([("c", "a", "b")], "contrast string, model_a string, model_b string")).count() == 1
    assert {r.model: (r.n_rows, r.n_common_rows) for r in pairing.sample_totals(panel).collect()} == {"a": (2, 1), "b": (1, 1), "__all__": (3, 2)}
    assert pairing.tagged(panel, group=None, model=["a", "b"]).count() == 2
    failures = spark.createDataFrame([("b", "9", "fit", "boom")], "model string, forecast_origin string, stage string, failure string")
    assert sorted(r.status for r in pairing.audit(panel, "b", failures).collect()) == ["missing_baseline_key", "run_failure"]
    meta = spark.createDataFrame([("a", "x", None), ("b", "y", "1")], "model string, commit string, hash string")
    fields = {"repository_commit": ["repository_commit", "commit"], "hash": ["hash"]}
    assert {r.field: (r.n_values, r.missing) for r in checks.compatible_metadata(meta, fields).collect()} == {"repository_commit": (2, []), "hash": (1, ["a"])}
    assert [r.field for r in checks.compatible_metadata(meta, fields, allow_missing=True).collect()] == ["repository_commit"]


def test_plans_policies_and_inspection(spark, tmp_path):
    assert planning.objective_variables(["a", "b", "c"], ["c", "a"], ["c"]) == (["a", "c"], ["c"]) and planning.objective_variables(["a"]) == (["a"], ["a"])
    for bad in (["d"], [], ["a", "a"]):
        with pytest.raises(DataError):
            planning.objective_variables(["a", "b"], bad)
    with pytest.raises(DataError):
        planning.split_vintages(spark.range(1), "other")
    jobs = [{"job_id": "x"}, {"job_id": "y", "needs": ["x"]}, {"job_id": "z", "needs": ["y"]}, {"job_id": "w"}]

    def run(job):
        if job["job_id"] == "y":
            raise ValueError("no")

    got = runstate.execute_jobs(jobs, {"w": "complete"}, run)
    assert [(g["action"], g["result"]) for g in got] == [("run", "complete"), ("run", "failed"), ("skip_missing_dep", None), ("skip", None)] and got[1]["error"] == "ValueError: no"
    runstate.prepare(tmp_path / "j", "hash")
    (tmp_path / "j" / "t.csv").write_text("a\n1\n")
    runstate.finish(tmp_path / "j", outputs=("t.csv",))
    found = runstate.inspect({"j": tmp_path / "j", "k": tmp_path / "k"}, {"t.csv": (["a", "b"], 1)})
    assert [(f["state"], f["ok"], f["faults"]) for f in found] == [("complete", False, ["t.csv: lacks b"]), ("missing", False, [])]


def test_benchmark_lags_are_by_aic_and_reported():
    from tideline.kernels import ridge

    rng = np.random.default_rng(3)
    y = np.zeros((90, 2))
    for t in range(2, 90):
        y[t] = [0.2 * y[t - 1, 0] + 0.35 * y[t - 2, 0], 0.5 * y[t - 1, 1]] + rng.standard_normal(2)
    got, lags = ridge.benchmark(y, "ar_univariate", [1, 2])
    want = [min(range(1, 5), key=lambda p: (ridge.information_criteria(y[:, j : j + 1], p)[0], p)) for j in range(2)]
    assert lags == want and got.shape == (2, 2)
    assert ridge.benchmark(y[:6], "ar_univariate", [1])[1][0] <= 2  # longer lags leave nothing to fit on
