import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import checks, inference, losses, metrics, pairing, selection
from tideline.schemas import DataError

COLUMNS = "model string, family string, size string, scope string, selection string, forecast_method string, group string, forecast_origin string, origin_ord long, target string, variable string, horizon int, forecast double, actual double, error double"


def panel(spark, errors, **tags):
    """errors: {model: {origin: error}}; a scope for each model may be given."""
    rows = []
    for model, by in errors.items():
        for o, e in by.items():
            rows.append((model, "ridge", None, tags.get(model, model), "once", "iterated", "all", str(o), o, str(o + 1), "y", 1, None if e is None else 1.0 + e, 1.0, e))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture
def unbalanced(spark):
    return panel(spark, {"pooled": {0: 10.0, 1: 10.0} | {k: 1.0 for k in range(2, 8)}, "horizon": {k: 2.0 for k in range(2, 8)}})


def test_losses_by_hand(spark):
    row = metrics.loss_by_target(panel(spark, {"a": {0: 1.0, 1: -1.0, 2: 2.0, 3: -2.0}})).first()
    assert row.rmse == pytest.approx(math.sqrt(10 / 4)) and row.n == 4
    assert metrics.loss_by_target(panel(spark, {"a": {0: 1.0, 1: -1.0, 2: 2.0, 3: -2.0}}), "mae").first().mae == 1.5


def test_null_errors_are_counted_but_not_valued(spark):
    row = metrics.loss_by_target(panel(spark, {"a": {0: 3.0, 1: None}})).first()
    assert row.rmse == 3.0 and row.n == 2


def test_common_sample_turns_the_winner(spark, unbalanced):
    raw = {r.model: r.rmse for r in metrics.loss_by_target(unbalanced, policy="advisory").collect()}
    assert raw["pooled"] == pytest.approx(math.sqrt(206 / 8)) and raw["horizon"] == 2
    rows = {r.model: r for r in metrics.loss_by_target(unbalanced).collect()}
    assert (rows["pooled"].rmse, rows["horizon"].rmse, rows["pooled"].n, rows["pooled"].n_excluded) == (1, 2, 6, 2)
    report = {r.model: r for r in pairing.sample_report(unbalanced).collect()}
    assert report["pooled"].n_common_keys == 6 and report["pooled"].n_excluded_keys == 2 and report["pooled"].coverage == 0.75
    gains = metrics.with_gains(metrics.scope_gains(unbalanced)).first()
    assert gains.horizon_gain == -1 and gains.loss_native is None
    with pytest.raises(DataError):
        pairing.common_sample(unbalanced, policy="raise")
    with pytest.raises(DataError):
        pairing.common_sample(unbalanced, min_coverage=0.9)


def test_disjoint_cells_lose_nothing(spark):
    two = panel(spark, {"a": {0: 1.0}}).unionByName(panel(spark, {"b": {0: 2.0}}).withColumn("variable", F.lit("z")))
    assert pairing.common_sample(two).count() == 2


def test_pairwise_baseline(spark, unbalanced):
    rows = {r.model: r for r in metrics.relative_rmse_pairwise(unbalanced, "horizon").collect()}
    assert rows["pooled"].relative == 0.5 and rows["pooled"].n == 6 and rows["horizon"].relative == 1
    scores = {r.model: r for r in pairing.paired_scores(panel(spark, {"paper": {0: 1.0, 1: 100.0}, "rival": {0: 2.0}}), "paper").collect()}
    s = scores["rival"]
    assert (s.rmse, s.baseline_rmse, s.n_model, s.n_baseline, s.n_common, s.percent_change, s.common_coverage) == (2, 1, 1, 2, 1, 100, 0.5)
    audit = pairing.exclusions(panel(spark, {"paper": {0: 1.0, 1: 100.0}, "rival": {0: 2.0}}), "paper").collect()
    assert [(r.model, r.status) for r in audit] == [("rival", "missing_model_key")]
    zero = metrics.relative_rmse(metrics.loss_by_target(panel(spark, {"a": {0: 0.0}, "b": {0: 1.0}})), "a").filter("model = 'b'").first()
    assert zero.relative is None and zero.percent is None


def test_ranks_share_ties_and_refuse_mixed_samples(spark):
    table = spark.createDataFrame([("a", "y", 1, 1.0, 3), ("b", "y", 1, 1.0, 3), ("c", "y", 1, 3.0, 3)], "model string, variable string, horizon int, rmse double, n long")
    assert {r.model: r.average_rank for r in metrics.average_ranks(table).collect()} == {"a": 1.5, "b": 1.5, "c": 3}
    with pytest.raises(DataError):
        metrics.average_ranks(table.withColumn("n", F.when(F.col("model") == "a", 4).otherwise(3)))


def test_gains_by_hand(spark):
    wide = spark.createDataFrame([(2.0, 1.0, 1.0, 0.5, None)], ", ".join(f"loss_{s} double" for s in metrics.SCOPES))
    g = metrics.with_gains(wide).first()
    assert (g.horizon_gain, g.variable_gain, g.interaction_gain, g.vh_vs_pooled, g.pooled_vs_native) == (1, 1, 0.5, 1.5, None)


def test_alignment(spark):
    rows = {r.model: r for r in pairing.origin_alignment(panel(spark, {"a": {k: 1.0 for k in range(6)}, "b": {k: 1.0 for k in range(3, 9)}})).collect()}
    assert (rows["a"].n_common, rows["a"].n_unmatched, rows["b"].n_unmatched) == (3, 3, 3)


def test_contrasts_pair_null_sizes(spark):
    found = pairing.scope_contrasts(panel(spark, {"m1": {0: 1.0}, "m2": {0: 1.0}}, m1="pooled", m2="horizon")).collect()
    assert [(r.model_a, r.model_b) for r in found] == [("m2", "m1")]


RECORDS = "origin int, variable string, horizon int, realization double, raw_error double, benchmark_error double, weight double"


def rec(spark, cells, bench=0.0):
    rows = [(i, v, 1, float(i), e, bench, w) for v, values in cells.items() for i, (e, w) in enumerate(values)]
    return spark.createDataFrame(rows, RECORDS)


def loss_of(df, **kw):
    return losses.selection_loss(df, losses.LossConfig(**kw)).first().selection_loss


def test_selection_losses_by_hand(spark):
    one = rec(spark, {"y": [(1.0, 1.0), (-2.0, 1.0), (3.0, 1.0)]})
    assert loss_of(one) == pytest.approx(math.sqrt(14 / 3)) and loss_of(one, kind="mae") == 2
    two = rec(spark, {"y": [(2.0, 1.0)], "z": [(0.0, 1.0)] * 3})
    assert loss_of(two, kind="mse") == 2 and loss_of(two, kind="mse", aggregation="equal_observation") == 1
    assert loss_of(rec(spark, {"y": [(2.0, 1.0)], "z": [(4.0, 1.0)]}), kind="mse", cell_weights={("y", 1): 3.0}) == 7
    assert loss_of(rec(spark, {"y": [(2.0, 3.0), (4.0, 1.0)]}), kind="mse") == 7
    assert loss_of(rec(spark, {"y": [(2.0, 1.0)], "z": [(2.0, 1.0)]}), kind="mse", normalise=False) == 8
    b = rec(spark, {"y": [(1.0, 1.0), (1.0, 1.0)]}).withColumn("benchmark_error", F.when(F.col("origin") == 0, 3.0).otherwise(4.0))
    assert losses.cell_values(b, losses.LossConfig(scaling="benchmark_rmse")).first().scale == pytest.approx(math.sqrt(12.5))
    low = losses.cell_values(one, losses.LossConfig(scaling="supplied", supplied={("y", 1): 1e-20}, min_scale=1e-6)).first()
    assert low.scale == 1e-6 and low.scale_floored
    with pytest.raises(Exception, match="no scale"):
        losses.cell_values(one, losses.LossConfig(scaling="supplied", supplied={("q", 1): 1.0})).collect()
    with pytest.raises(DataError):
        losses.LossConfig(kind="huber")


def test_candidate_ties_prefer_the_simplest(spark):
    rows = [(1.0, 2, 1.0, 1.0, 0.5), (1.0, 1, 1.0, 1.0, 0.5), (9.0, 1, 1.0, 1.0, 0.5), (9.0, 1, 1.0, 2.0, 0.5), (1.0, 1, 0.0, 1.0, float("inf")), (1.0, 1, 0.0, 1.0, None), (5.0, 1, 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame([("c", *r) for r in rows], "cell string, lam double, p int, alpha double, kappa double, loss double")
    for order in (df, df.orderBy(F.desc("lam"), "p")):
        b = selection.best_candidate(order, ["cell"]).first()
        assert (b.lam, b.p, b.kappa, b.n_tied) == (9, 1, 1, 4)
    assert selection.best_candidate(df.filter("isnan(loss)"), ["cell"]).count() == 0


def test_origin_picks(spark):
    o = spark.createDataFrame([(i,) for i in range(10, 20)], "origin int")
    pick = lambda *a, **k: sorted(r.origin for r in selection.pick_origins(o, *a, **k).collect())
    assert pick(3) == [17, 18, 19] and pick(3, "evenly_spaced") == [10, 14, 19] and pick(1, "evenly_spaced") == [10]
    assert pick(4, "random", seed=3) == pick(4, "random", seed=3) and len(set(pick(4, "random"))) == 4


def test_lag_choice(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 2, None)], "k string, p int, aic double")
    assert {r.k: r.p for r in selection.choose_lag(df, ["k"], "aic").collect()} == {"a": 2, "b": 1}


def series(spark, values):
    return spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "contrast string, i int, d double")


def test_long_run_variance(spark):
    lrv = lambda v, lag, kernel="bartlett": inference.long_run_variance(series(spark, v), ["contrast"], ["i"], lag, kernel).first().long_run_variance
    assert lrv([1, 2, 3, 4, 5], 0) == pytest.approx(2)
    c = [-1.5, 0.5, -0.5, 1.5]
    g0, g1 = sum(a * a for a in c) / 4, sum(a * b for a, b in zip(c, c[1:])) / 4
    assert lrv([1, 3, 2, 4], 1, "uniform") == pytest.approx(g0 + 2 * g1)
    assert lrv([1, 3, 2, 4], 1) == pytest.approx(g0 + g1)
    assert lrv([1, 3], 9, "uniform") == pytest.approx(1 + 2 * -0.5)


def test_dm_refuses_and_tests(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=40), 2 * rng.normal(size=40)
    both = panel(spark, {"a": dict(enumerate(a.tolist())), "b": dict(enumerate(b.tolist()))})
    contrast = spark.createDataFrame([("a", "b", "a vs b")], "model_a string, model_b string, contrast string")
    r = inference.dm_tests(pairing.paired_errors(both, contrast)).first()
    d = a**2 - b**2
    t = d.mean() / np.sqrt(d.var() / 40) * np.sqrt(39 / 40)
    assert r.statistic == pytest.approx(t) and 0 < r.p_value < 0.01 and r.p_holm == r.p_value
    same = panel(spark, {"a": dict(enumerate(a.tolist())), "b": dict(enumerate(a.tolist()))})
    z = inference.dm_tests(pairing.paired_errors(same, contrast)).first()
    assert not z.valid and z.reason == "zero variance" and z.p_value is None
    few = inference.dm_statistics(pairing.paired_errors(panel(spark, {"a": {0: 1.0, 1: 2.0, 2: 1.0}, "b": {0: 2.0, 1: 1.0, 2: 3.0}}), contrast)).first()
    assert not few.valid and "small" in few.reason
    null = inference.dm_statistics(pairing.paired_errors(panel(spark, {"a": dict(enumerate(a.tolist())) | {3: None}, "b": dict(enumerate(b.tolist()))}), contrast)).first()
    assert not null.valid and null.reason == "missing errors"
    one = inference.bootstrap_intervals(pairing.paired_errors(both, contrast)).first()
    again = inference.bootstrap_intervals(pairing.paired_errors(both, contrast)).first()
    assert one == again and one.low < d.mean() < one.high and one.valid
    assert inference.bootstrap_intervals(pairing.paired_errors(both, contrast), "stationary").first().valid


def test_t_tail_matches_known_values():
    from tideline.functions.special import t_two_sided

    known = [(12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (2.0, 30, 0.054631), (0.0, 5, 1.0), (40.0, 3, 3.4358e-05)]
    for t, v, p in known:
        assert float(t_two_sided(t, v)) == pytest.approx(p, rel=1e-3)


def test_t_tail_matches_integration_at_any_degrees():
    import math

    import numpy as np

    from tideline.functions.special import t_two_sided

    def integral(t, v, n=200_001):  # of the density from t on, by x = t + s / (1 - s)
        s = (np.arange(n) + 0.5) / n
        x = t + s / (1 - s)
        level = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
        return 2 * np.mean(np.exp(level - (v + 1) / 2 * np.log1p(x * x / v)) / (1 - s) ** 2)

    for v in (1, 2, 7, 74, 199, 400, 1000, 5000, 10**5, 10**6):
        for t in (0.001, 0.3, 1.0, 2.0, 3.0, 6.0):
            assert float(t_two_sided(t, v)) == pytest.approx(integral(t, v), rel=1e-6), (t, v)
    many = np.random.default_rng(0).standard_normal(2000) * 4
    for v in (3, 999.0, 1e6, 1e8):
        p = t_two_sided(many, np.full(2000, v))
        assert np.isfinite(p).all() and (np.diff(p[np.argsort(np.abs(many))]) <= 1e-12).all()
    assert float(t_two_sided(math.inf, 5)) < 1e-300 and float(t_two_sided(0.0, 5)) == 1.0


def test_holm_by_hand(spark):
    df = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.04, 0.03, 0.02, 0.01])], "family string, k int, p_value double")
    assert [round(r.p_holm, 6) for r in inference.holm(df, ["family"]).orderBy("k").collect()] == [0.06, 0.06, 0.06, 0.04]
    df = spark.createDataFrame([("f", 0, 0.01), ("f", 1, None), ("f", 2, float("nan")), ("f", 3, 0.02)], "family string, k int, p_value double")
    assert [r.p_holm for r in inference.holm(df, ["family"]).orderBy("k").collect()] == [0.02, None, None, 0.02]


def test_checks_raise(spark):
    df = panel(spark, {"a": {0: 1.0}})
    with pytest.raises(DataError):
        checks.enforce(checks.duplicate_keys(df.union(df), ["model", "forecast_origin"]), "keys")
    checks.enforce(checks.duplicate_keys(df, ["model", "forecast_origin"]), "keys")
    a = checks.content_hash(df, df.columns, ["model"]).first()
    assert a == checks.content_hash(df.repartition(3), df.columns, ["model"]).first() and a != checks.content_hash(df.withColumn("error", F.lit(2.0)), df.columns, ["model"]).first()
