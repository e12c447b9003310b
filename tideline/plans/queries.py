"""Queries over the derived tables, each with the SQL that it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods, scalars
from ..functions.tables import hold, literal_table
from ..kernels import bvar
from ..operators import checks, draws, inference, losses, metrics, pairing, selection, vintage
from . import datasets as D
from . import experiment, planning, report, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records: realization less forecast."""
    return D.forecasts(spark, sf_dir).select("model", "variable", "horizon", "origin", F.col("actual").alias("realization"), "forecast", (-F.col("error")).alias("raw_error"))


C, FC = D.CANONICAL_SQL, D.FORECASTS_SQL


# Comparison ----------------------------------------------------------------------------------------------------------


@query(C + """, base AS (SELECT * FROM panel WHERE model = 'no_change')
SELECT p.model, p.variable, p.horizon, count(*) AS n, round(sqrt(avg(p.error * p.error)), 6) AS rmse, round(sqrt(avg(b.error * b.error)), 6) AS baseline_rmse,
  round(sqrt(avg(p.error * p.error)) / sqrt(avg(b.error * b.error)), 6) AS relative, 'pairwise' AS sample_basis
FROM panel p JOIN base b ON p.variable = b.variable AND p.horizon = b.horizon AND p.origin = b.origin GROUP BY 1, 2, 3""")
def relative_rmse_pairwise(spark, sf):
    return rounded(metrics.relative_rmse_pairwise(D.panel(spark, sf), "no_change"))


def _by_target(kind: str) -> str:
    value = {"rmse": "sqrt(avg(error * error))", "mae": "avg(abs(error))"}[kind]
    return C + f"""SELECT k.*, t.n_total, t.n_total - k.n AS n_excluded FROM (SELECT model, variable, horizon, round({value}, 6) AS {kind}, count(*) AS n FROM common GROUP BY 1, 2, 3) k
JOIN (SELECT model, variable, horizon, count(*) AS n_total FROM panel GROUP BY 1, 2, 3) t USING (model, variable, horizon)"""


@query(_by_target("rmse"))
def rmse_by_target(spark, sf):
    return rounded(metrics.loss_by_target(D.panel(spark, sf), "rmse"))


@query(_by_target("mae"))
def mae_by_target(spark, sf):
    return rounded(metrics.loss_by_target(D.panel(spark, sf), "mae"))


@query(C + "SELECT model, 'average' AS family, CAST(NULL AS VARCHAR) AS size, scope, 'once' AS selection, 'iterated' AS forecast_method, variable, horizon, round(avg(error * error), 6) AS loss, count(*) AS n FROM common GROUP BY model, scope, variable, horizon")
def cell_losses(spark, sf):
    return rounded(metrics.cell_losses(D.panel(spark, sf), "mse"))


@query(C + """SELECT r.model, r.variable, r.horizon, r.n_rows, r.n_common_rows, k.n_common_keys, k.n_keys - k.n_common_keys AS n_excluded_keys, round(r.n_common_rows / r.n_rows, 6) AS coverage
FROM (SELECT p.model, p.variable, p.horizon, count(*) AS n_rows, count(s.origin) AS n_common_rows FROM panel p LEFT JOIN shared s ON p.variable = s.variable AND p.horizon = s.horizon AND p.origin = s.origin GROUP BY 1, 2, 3) r
JOIN (SELECT p.variable, p.horizon, count(DISTINCT p.origin) AS n_keys, count(DISTINCT s.origin) AS n_common_keys FROM panel p LEFT JOIN shared s ON p.variable = s.variable AND p.horizon = s.horizon AND p.origin = s.origin GROUP BY 1, 2) k USING (variable, horizon)""")
def common_sample_report(spark, sf):
    return rounded(pairing.sample_report(D.panel(spark, sf)))


PAIRED = C + """, base AS (SELECT variable, horizon, origin, error AS base_error FROM panel WHERE model = 'no_change'),
wide AS (SELECT c.model, b.* FROM base b JOIN (SELECT DISTINCT model, variable, horizon FROM panel) c USING (variable, horizon)),
paired AS (SELECT model, variable, horizon, origin, p.error, w.base_error, p.origin IS NOT NULL AS mine, w.origin IS NOT NULL AS theirs FROM panel p FULL JOIN wide w USING (model, variable, horizon, origin)),
status AS (SELECT *, CASE WHEN error IS NULL THEN 'missing_model_key' WHEN base_error IS NULL THEN 'missing_baseline_key' ELSE 'common' END AS status FROM paired)"""


@query(PAIRED + """SELECT model, variable, horizon, round(sqrt(avg(CASE WHEN status = 'common' THEN error * error END)), 6) AS rmse, round(sqrt(avg(CASE WHEN status = 'common' THEN base_error * base_error END)), 6) AS baseline_rmse,
  count(error) AS n_model, count(base_error) AS n_baseline, count(*) FILTER (status = 'common') AS n_common, count(error) FILTER (status <> 'common') AS excluded_model, count(base_error) FILTER (status <> 'common') AS excluded_baseline,
  round(count(*) FILTER (status = 'common') / greatest(count(error), count(base_error)), 6) AS common_coverage,
  round(100 * (sqrt(avg(CASE WHEN status = 'common' THEN error * error END)) / sqrt(avg(CASE WHEN status = 'common' THEN base_error * base_error END)) - 1), 6) + 0.0 AS percent_change
FROM status GROUP BY 1, 2, 3""")
def paired_score_table(spark, sf):
    return rounded(pairing.paired_scores(D.panel(spark, sf), "no_change"))


@query(PAIRED + "SELECT model, variable, horizon, CAST(origin AS VARCHAR) AS forecast_origin, status FROM status WHERE status <> 'common'")
def exclusion_audit(spark, sf):
    return pairing.exclusions(D.panel(spark, sf), "no_change").select("model", "variable", "horizon", "forecast_origin", "status")


@query(PAIRED + "SELECT model, status, count(*) AS n FROM status GROUP BY 1, 2")
def exclusion_status_counts(spark, sf):
    return pairing.paired(D.panel(spark, sf), "no_change").groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


RMSE = C + ", rmse AS (SELECT model, variable, horizon, sqrt(avg(error * error)) AS rmse, count(*) AS n FROM common GROUP BY 1, 2, 3)"


@query(RMSE + """SELECT r.model, r.variable, r.horizon, round(r.rmse, 6) AS rmse, round(b.rmse, 6) AS baseline_rmse, round(r.rmse / b.rmse, 6) AS relative, round(100 * (r.rmse - b.rmse) / b.rmse, 6) + 0.0 AS percent
FROM rmse r LEFT JOIN (SELECT * FROM rmse WHERE model = 'no_change') b USING (variable, horizon)""")
def relative_rmse(spark, sf):
    return rounded(metrics.relative_rmse(metrics.loss_by_target(D.panel(spark, sf)), "no_change"))


@query(RMSE + """SELECT model, round(avg(r), 6) AS average_rank, count(*) AS n_cells FROM (SELECT model, rank() OVER (PARTITION BY variable, horizon ORDER BY rmse) + (count(*) OVER (PARTITION BY variable, horizon, rmse) - 1) / 2.0 AS r FROM rmse) GROUP BY 1""")
def average_ranks(spark, sf):
    return rounded(metrics.average_ranks(metrics.loss_by_target(D.panel(spark, sf))))


LOSSES = C + """, losses AS (SELECT 'average' AS family, CAST(NULL AS VARCHAR) AS size, 'iterated' AS forecast_method, variable, horizon,
  sqrt(avg(error * error) FILTER (scope = 'pooled')) AS loss_pooled, sqrt(avg(error * error) FILTER (scope = 'horizon')) AS loss_horizon, sqrt(avg(error * error) FILTER (scope = 'variable')) AS loss_variable,
  sqrt(avg(error * error) FILTER (scope = 'variable_horizon')) AS loss_variable_horizon, CAST(NULL AS DOUBLE) AS loss_native FROM common GROUP BY variable, horizon),
gains AS (SELECT *, loss_pooled - loss_horizon AS horizon_gain, loss_pooled - loss_variable AS variable_gain, least(loss_horizon, loss_variable) - loss_variable_horizon AS interaction_gain, loss_pooled - loss_variable_horizon AS vh_vs_pooled, loss_native - loss_pooled AS pooled_vs_native FROM losses)"""


@query(LOSSES + "SELECT family, size, forecast_method, variable, horizon, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["loss_" + s for s in metrics.SCOPES] + metrics.GAINS) + " FROM gains")
def scope_gains(spark, sf):
    return rounded(metrics.with_gains(metrics.scope_gains(D.panel(spark, sf))))


@query(LOSSES + """, long AS (SELECT unnest(['horizon_gain', 'variable_gain', 'interaction_gain', 'vh_vs_pooled', 'pooled_vs_native']) AS gain, unnest([horizon_gain, variable_gain, interaction_gain, vh_vs_pooled, pooled_vs_native]) AS value FROM gains)
SELECT gain, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(least(min(value), 0), 6) AS worst, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive FROM long WHERE value IS NOT NULL GROUP BY 1""")
def scope_gain_summary(spark, sf):
    return rounded(metrics.gain_summary(metrics.with_gains(metrics.scope_gains(D.panel(spark, sf)))))


@query(C + """, o AS (SELECT DISTINCT model, origin FROM panel), s AS (SELECT origin, count(*) AS have FROM o GROUP BY 1)
SELECT model, count(*) AS n_origins, count(*) FILTER (have = 4) AS n_common, count(*) FILTER (have <> 4) AS n_unmatched FROM o JOIN s USING (origin) GROUP BY 1""")
def origin_alignment(spark, sf):
    return pairing.origin_alignment(D.panel(spark, sf))


@query(C + """, tags AS (SELECT DISTINCT model, scope FROM panel), w(a, b) AS (VALUES ('horizon', 'pooled'), ('variable', 'pooled'), ('variable_horizon', 'pooled'), ('variable_horizon', 'horizon'), ('variable_horizon', 'variable'), ('pooled', 'native'))
SELECT 'scope' AS kind, x.model AS model_a, y.model AS model_b, x.model || ' vs ' || y.model AS contrast FROM w JOIN tags x ON x.scope = a JOIN tags y ON y.scope = b""")
def scope_contrasts(spark, sf):
    return pairing.scope_contrasts(D.panel(spark, sf))


@query(C + """, planted AS (SELECT variable, horizon, origin, actual + CASE WHEN model = 'mean_5' AND origin % 6 = 0 THEN 0.25 WHEN model = 'mean_3' AND origin % 6 = 1 THEN 0.0000005 ELSE 0 END AS actual FROM panel)
SELECT variable, horizon, CAST(origin AS VARCHAR) AS forecast_origin, round(max(actual) - min(actual), 6) AS spread, count(*) AS n FROM planted GROUP BY variable, horizon, origin HAVING max(actual) - min(actual) > 0.000001""")
def realisation_consistency(spark, sf):
    """Actuals that differ between models, on a panel with planted differences above and below the tolerance."""
    origin = F.col("origin_ord")
    moved = F.when((F.col("model") == "mean_5") & (origin % 6 == 0), 0.25).when((F.col("model") == "mean_3") & (origin % 6 == 1), 0.0000005).otherwise(0.0)
    bad = checks.inconsistent_actuals(D.panel(spark, sf).withColumn("actual", F.col("actual") + moved), ["variable", "horizon", "forecast_origin"])
    return rounded(bad.select("variable", "horizon", "forecast_origin", (F.col("greatest") - F.col("least")).alias("spread"), "n"))


@query("SELECT l_orderkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return checks.duplicate_keys(D.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey", "l_suppkey"])


# Inference -----------------------------------------------------------------------------------------------------------

DIFFERENTIALS = C + """, pairs AS (
  SELECT q.a || ' vs ' || q.b AS contrast, x.variable, x.horizon, x.origin, x.error * x.error - y.error * y.error AS d
  FROM (VALUES ('seasonal_naive', 'no_change'), ('mean_3', 'no_change'), ('mean_5', 'no_change'), ('mean_5', 'seasonal_naive'), ('mean_5', 'mean_3')) AS q(a, b)
  JOIN panel x ON x.model = q.a JOIN panel y ON y.model = q.b AND x.variable = y.variable AND x.horizon = y.horizon AND x.origin = y.origin),
centred AS (SELECT *, d - avg(d) OVER w AS c, count(*) OVER w AS n, row_number() OVER (PARTITION BY contrast, variable, horizon ORDER BY origin) AS i FROM pairs WINDOW w AS (PARTITION BY contrast, variable, horizon)),
gammas AS (SELECT a.contrast, a.variable, a.horizon, a.n, k.k, sum(a.c * b.c) / a.n AS gamma FROM centred a JOIN (VALUES (0), (1), (2), (3)) AS k(k) ON k.k < a.horizon JOIN centred b ON a.contrast = b.contrast AND a.variable = b.variable AND a.horizon = b.horizon AND a.i = b.i + k.k GROUP BY 1, 2, 3, 4, 5),
lrv AS (SELECT contrast, variable, horizon, n, sum(gamma * CASE WHEN k = 0 THEN 1.0 ELSE 2.0 * (1 - k / CAST(horizon AS DOUBLE)) END) AS v FROM gammas GROUP BY 1, 2, 3, 4)"""


def contrast_pairs(spark, sf):
    panel = D.panel(spark, sf)  # both sides of the pairing and the contrasts read it, from one shuffle
    return pairing.paired_errors(panel, pairing.scope_contrasts(panel))


@query(DIFFERENTIALS + "SELECT contrast, variable, horizon, round(v, 2) AS long_run_variance, n FROM lrv")
def hac_variance(spark, sf):
    rows = inference.loss_differentials(contrast_pairs(spark, sf)).withColumn("max_lag", F.col("horizon") - 1)
    out = inference.long_run_variance(rows, ["contrast", "variable", "horizon"], ["origin_ord"], None, longest=max(D.HORIZONS) - 1)
    return rounded(out.select("contrast", "variable", "horizon", "long_run_variance", "n"), 2)


@query(DIFFERENTIALS + """SELECT l.contrast, l.variable, l.horizon, l.n AS n_pairs, round(m.mean_d, 5) + 0.0 AS mean_differential,
  CASE WHEN l.n >= greatest(8, l.horizon + 1) AND v > 0.000000000001 THEN round(m.mean_d / sqrt(v / l.n) * sqrt((l.n + 1 - 2 * l.horizon + l.horizon * (l.horizon - 1) / CAST(l.n AS DOUBLE)) / l.n), 5) + 0.0 END AS statistic, l.n >= greatest(8, l.horizon + 1) AND v > 0.000000000001 AS valid
FROM lrv l JOIN (SELECT contrast, variable, horizon, avg(d) AS mean_d FROM pairs GROUP BY 1, 2, 3) m USING (contrast, variable, horizon)""")
def dm_statistics(spark, sf):
    return rounded(inference.dm_statistics(contrast_pairs(spark, sf), longest=max(D.HORIZONS)).select("contrast", "variable", "horizon", "n_pairs", "mean_differential", "statistic", "valid"), 5)


@query()
def dm_tests(spark, sf):
    return inference.dm_tests(contrast_pairs(spark, sf), longest=max(D.HORIZONS))


@query()
def bootstrap_intervals(spark, sf):
    return inference.bootstrap_intervals(contrast_pairs(spark, sf), draws=1000)


@query("""WITH p AS (SELECT c_nationkey AS family, c_custkey AS test, round(abs(c_acctbal) / 20000, 8) AS p FROM customer),
s AS (SELECT family, test, p, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS step FROM p)
SELECT family, test, p, round(max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s""")
def holm_adjustment(spark, sf):
    p = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("test"), F.round(F.abs("c_acctbal") / 20000, 8).alias("p"))
    return rounded(inference.holm(p.withColumn("variable", F.lpad(F.col("test").cast("string"), 20, "0")), ["family"], "p").drop("variable"), 8)


# Losses and selection ------------------------------------------------------------------------------------------------

REC = FC + ", r AS (SELECT model, variable, horizon, origin, actual AS realization, -error AS e FROM forecasts)"


@query(REC + """, c AS (SELECT model, variable, horizon, count(*) AS n, avg(e * e) / (greatest(stddev_samp(realization), 0.00000001) * greatest(stddev_samp(realization), 0.00000001)) AS v FROM r GROUP BY 1, 2, 3)
SELECT model, round(sqrt(sum(v * n) / sum(n)), 6) AS selection_loss, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_records FROM c GROUP BY 1""")
def selection_loss(spark, sf):
    return rounded(losses.selection_loss(records(spark, sf), losses.LossConfig(scaling="target_std", aggregation="equal_observation"), ["model"]))


@query(REC + """, b AS (SELECT variable, horizon, origin, e FROM r WHERE model = 'no_change'),
c AS (SELECT x.model, x.variable, x.horizon, count(*) AS n, greatest(sqrt(avg(b.e * b.e)), 0.00000001) AS scale, avg(abs(x.e)) AS a FROM r x JOIN b USING (variable, horizon, origin) WHERE x.model <> 'no_change' GROUP BY 1, 2, 3)
SELECT model, round(avg(a / scale), 6) AS selection_loss, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_records FROM c GROUP BY 1""")
def benchmark_scaled_loss(spark, sf):
    rows = records(spark, sf)
    base = rows.filter("model = 'no_change'").select("origin", "variable", "horizon", "forecast")
    return rounded(losses.selection_loss(losses.attach_benchmark(rows.filter("model <> 'no_change'"), base), losses.LossConfig(kind="mae", scaling="benchmark_rmse"), ["model"]))


@query(REC + """, c AS (SELECT model, variable, horizon, count(*) AS n, avg(e * e) AS v FROM r GROUP BY 1, 2, 3)
SELECT model, variable, horizon, n, round(v, 6) AS value, round(v * n, 4) AS contribution, round(v * n / sum(v * n) OVER (PARTITION BY model), 6) AS share FROM c""")
def loss_contributions(spark, sf):
    out = losses.cell_shares(records(spark, sf), losses.LossConfig(kind="mse", aggregation="equal_observation"), ["model"])
    return out.select("model", "variable", "horizon", "n", F.round("value", 6).alias("value"), F.round("contribution", 4).alias("contribution"), F.round("share", 6).alias("share"))


@query(REC + "SELECT variable, horizon, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, count(*) AS n FROM r WHERE model = 'mean_3' GROUP BY GROUPING SETS ((variable, horizon), ())")
def outer_metrics(spark, sf):
    return rounded(losses.outer_metrics(records(spark, sf).filter("model = 'mean_3'")))


@query(REC + "SELECT model, round(sqrt(avg(mse)), 6) AS rmse, count(*) AS n_variables FROM (SELECT model, variable, avg(e * e) AS mse FROM r GROUP BY 1, 2) GROUP BY 1")
def equal_variable_rmse(spark, sf):
    return rounded(losses.equal_variable_rmse(records(spark, sf), ["model"]))


MEANS = "WITH " + D.PANEL_SQL + """, l AS (SELECT g.variable, g.m, k.p, a.lam, avg(h.y) * (1 / (1 + a.lam)) AS f, any_value(t.y) AS y, count(*) AS c FROM growth g CROSS JOIN (VALUES (1), (2), (4)) AS k(p) CROSS JOIN (VALUES (0.0), (0.5), (2.0)) AS a(lam)
  JOIN growth h ON h.variable = g.variable AND h.m BETWEEN g.m - k.p + 1 AND g.m JOIN growth t ON t.variable = g.variable AND t.m = g.m + 1 GROUP BY 1, 2, 3, 4),
loss AS (SELECT variable, p, CAST(lam AS DOUBLE) AS lam, round(sqrt(avg((f - y) * (f - y))), 4) AS loss FROM l WHERE c = p GROUP BY 1, 2, 3)"""


def mean_losses(spark, sf):
    """Losses of shrunken moving means over a grid of lengths and shrinkages."""
    g = D.growth(spark, sf)
    grid = planning.grid(spark, lam=(0.0, 0.5, 2.0), p=(1, 2, 4), alpha=(0.0,), kappa=(1.0,)).select("lam", "p", "alpha", "kappa")
    w = Window.partitionBy("variable").orderBy("m").rangeBetween
    base = Window.partitionBy("variable").orderBy("m")
    wide = g.select("variable", "m", F.lead("y").over(base).alias("y1"), F.lead("m").over(base).alias("m1"), *[F.when(F.count("y").over(w(1 - k, 0)) == k, F.avg("y").over(w(1 - k, 0))).alias(f"f{k}") for k in (1, 2, 4)])
    long = wide.filter("m1 = m + 1").select("variable", "y1", F.explode(F.create_map(*[x for k in (1, 2, 4) for x in (F.lit(k), F.col(f"f{k}"))])).alias("p", "f")).filter("f is not null")
    return long.join(grid, "p").groupBy("variable", "p", "lam", "alpha", "kappa").agg(F.round(F.sqrt(F.avg(F.pow(F.col("f") / (1 + F.col("lam")) - F.col("y1"), 2))), 4).alias("loss"))


@query(MEANS + """, near AS (SELECT *, min(loss) OVER (PARTITION BY variable) AS least FROM loss), tied AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY p, lam DESC) AS k, count(*) OVER (PARTITION BY variable) AS n_tied FROM near WHERE loss <= least + 0.5)
SELECT variable, lam, p, CAST(0 AS DOUBLE) AS alpha, CAST(1 AS DOUBLE) AS kappa, loss, n_tied FROM tied WHERE k = 1""")
def best_candidate(spark, sf):
    return selection.best_candidate(mean_losses(spark, sf), ["variable"], 0.5)


@query(MEANS + "SELECT variable, arg_min(p, [loss, p]) AS p, min(loss) AS loss FROM loss WHERE lam = 0 GROUP BY 1")
def first_best(spark, sf):
    return selection.first_best(mean_losses(spark, sf).filter("lam = 0"), ["variable"], "p")


@query(MEANS + "SELECT variable, coalesce(arg_min(p, [loss, p]) FILTER (variable <> '5-LOW'), 1) AS p FROM loss WHERE lam = 0.5 GROUP BY 1")
def chosen_lags(spark, sf):
    """The length of least loss; where no loss is known, 1."""
    known = F.when(F.col("variable") != "5-LOW", F.col("loss"))
    return selection.choose_lag(mean_losses(spark, sf).filter("lam = 0.5").withColumn("loss", known), ["variable"], "loss")


@query("WITH " + D.PANEL_SQL + """, s AS (SELECT variable, m, m % 4 AS choice, m % 3 / 2.0 AS level FROM growth)
SELECT 'system' AS model, 'choice' AS parameter, avg(choice) AS mean, round(stddev_samp(choice), 6) AS std, CAST(min(choice) AS DOUBLE) AS min, CAST(max(choice) AS DOUBLE) AS max, count(*) AS n FROM s WHERE variable = (SELECT min(variable) FROM s)
UNION ALL SELECT 'system', 'level', avg(level), round(stddev_samp(level), 6), min(level), max(level), count(*) FROM s WHERE variable = (SELECT min(variable) FROM s)""".replace("avg(choice)", "round(avg(choice), 6)").replace("avg(level)", "round(avg(level), 6)").replace("m % 3 / 2.0", "CAST(m % 3 AS DOUBLE) / 2"))
def parameter_summary(spark, sf):
    g = D.growth(spark, sf)
    one = g.join(F.broadcast(g.agg(F.min("variable").alias("first"))), F.col("variable") == F.col("first"))  # one row
    chosen = one.select(F.lit("system").alias("model"), (F.col("m") % 4).alias("choice"), ((F.col("m") % 3).cast("double") / 2).alias("level"))
    return rounded(metrics.parameter_summary(chosen, ["choice", "level"]))


@query("WITH " + D.PANEL_SQL + """, s AS (SELECT variable, m, y > 0 AS v, CASE WHEN y > 0 THEN 'up' ELSE 'down' END AS c FROM growth), l AS (SELECT *, lag(c) OVER (PARTITION BY variable ORDER BY m) AS b FROM s),
k AS (SELECT variable, c, count(*) AS n, sum(CASE WHEN c <> b THEN 1 ELSE 0 END) AS sw FROM l GROUP BY 1, 2)
SELECT variable, CAST(sum(n) AS BIGINT) AS n_origins, count(*) AS n_unique, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS modal_fraction, CAST(sum(sw) AS BIGINT) AS n_switches FROM k GROUP BY 1""")
def selection_stability(spark, sf):
    chosen = D.growth(spark, sf).withColumn("choice", F.when(F.col("y") > 0, "up").otherwise("down"))
    return rounded(metrics.selection_stability(chosen, "choice", ["variable"], "m"))


@query("WITH " + D.PANEL_SQL + """, x AS (SELECT variable, m, y, lag(y) OVER (PARTITION BY variable ORDER BY m) AS y1 FROM growth),
k AS (SELECT variable, m, regr_slope(y, y1) OVER w AS b, regr_intercept(y, y1) OVER w AS a, count(y1) OVER w AS n, y FROM x WINDOW w AS (PARTITION BY variable ORDER BY m ROWS UNBOUNDED PRECEDING))
SELECT variable, m, round(a, 5) AS intercept, round(b, 5) AS slope, round(a + b * y, 5) AS forecast FROM k WHERE n >= 12""")
def expanding_ar1(spark, sf):
    w = Window.partitionBy("variable").orderBy("m")
    x = D.growth(spark, sf).withColumn("y1", F.lag("y").over(w))
    e = w.rowsBetween(Window.unboundedPreceding, 0)
    k = x.select("variable", "m", "y", F.regr_slope("y", "y1").over(e).alias("slope"), F.regr_intercept("y", "y1").over(e).alias("intercept"), F.count("y1").over(e).alias("n")).filter("n >= 12")
    return rounded(k.select("variable", "m", "intercept", "slope", (F.col("intercept") + F.col("slope") * F.col("y")).alias("forecast")), 5)


@query("WITH " + D.PANEL_SQL + """, x AS (SELECT variable, y, lag(y) OVER (PARTITION BY variable ORDER BY m) AS y1 FROM growth), f AS (SELECT variable, regr_sxx(y1, y1) AS q, regr_slope(y, y1) AS b, regr_intercept(y, y1) AS a, count(*) AS t FROM x WHERE y1 IS NOT NULL GROUP BY 1),
s AS (SELECT x.variable, any_value(t) AS t, sum((y - a - b * y1) * (y - a - b * y1)) AS sse FROM x JOIN f USING (variable) WHERE y1 IS NOT NULL GROUP BY 1)
SELECT variable, t AS n_obs, round(ln(sse / t) + 2.0 / t, 6) AS aic, round(ln(sse / t) + ln(t) / t, 6) AS bic FROM s""")
def information_criteria(spark, sf):
    x = D.growth(spark, sf).withColumn("y1", F.lag("y").over(Window.partitionBy("variable").orderBy("m"))).filter("y1 is not null")
    fit = x.groupBy("variable").agg(F.regr_slope("y", "y1").alias("b"), F.regr_intercept("y", "y1").alias("a"))
    e = F.col("y") - F.col("a") - F.col("b") * F.col("y1")
    s = x.join(fit, "variable").groupBy("variable").agg(F.count(F.lit(1)).alias("n_obs"), F.sum(e * e).alias("sse"))
    level = F.ln(F.col("sse") / F.col("n_obs"))
    return rounded(s.select("variable", "n_obs", (level + 2 / F.col("n_obs")).alias("aic"), (level + F.ln("n_obs") / F.col("n_obs")).alias("bic")))


# Planning ------------------------------------------------------------------------------------------------------------


def _targets(spark, sf):
    variables = D.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variable")).distinct()
    return planning.targets(variables, literal_table(spark, [(h,) for h in D.HORIZONS], "horizon int"))


PLAN = """WITH t AS (SELECT variable, horizon FROM (SELECT DISTINCT o_orderpriority AS variable FROM orders) CROSS JOIN (VALUES (1), (2), (4)) AS h(horizon)),
s AS (SELECT *, trim(regexp_replace(lower(variable), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t),
plan AS (SELECT 'pooled' AS scope, 'pooled' AS cell_id, variable, horizon FROM s UNION ALL SELECT 'horizon', 'horizon-h' || horizon, variable, horizon FROM s UNION ALL SELECT 'variable', 'variable-' || slug, variable, horizon FROM s
  UNION ALL SELECT 'variable_horizon', 'variable-' || slug || '-h' || horizon, variable, horizon FROM s)"""


@query(PLAN + "SELECT * FROM plan")
def selection_plan(spark, sf):
    return planning.selection_plan(_targets(spark, sf)).select("scope", "cell_id", "variable", "horizon")


@query(PLAN + """, faulty AS (SELECT variable, horizon FROM plan WHERE scope = 'variable' AND NOT (variable = '1-URGENT' AND horizon = 4) UNION ALL SELECT variable, horizon FROM plan WHERE scope = 'pooled' AND variable = '2-HIGH' UNION ALL VALUES ('9-NONE', 1))
SELECT coalesce(t.variable, f.variable) AS variable, coalesce(t.horizon, f.horizon) AS horizon, coalesce(f.n, 0) AS n_cells, t.variable IS NOT NULL AS asked
FROM t FULL JOIN (SELECT variable, horizon, count(*) AS n FROM faulty GROUP BY 1, 2) f ON t.variable = f.variable AND t.horizon = f.horizon WHERE coalesce(f.n, 0) <> 1 OR t.variable IS NULL""")
def partition_check(spark, sf):
    """Faults of a plan that lacks a target, holds some twice and has one that wasn't asked for."""
    wanted = _targets(spark, sf)
    plan = planning.selection_plan(wanted).select("scope", "variable", "horizon")
    once = plan.filter("scope = 'variable' and not (variable = '1-URGENT' and horizon = 4)")
    twice = plan.filter("scope = 'pooled' and variable = '2-HIGH'")
    return checks.partition_faults(once.union(twice).union(literal_table(spark, [("x", "9-NONE", 1)], "scope string, variable string, horizon int")), wanted)


@query("""WITH v AS (SELECT DISTINCT o_orderpriority AS variable FROM orders) SELECT variable, CASE WHEN variable IN ('1-URGENT', '2-HIGH') THEN 'Fast' WHEN variable = '5-LOW' THEN 'Slow' ELSE 'other' END AS "group" FROM v""")
def residual_groups(spark, sf):
    return planning.grouped_variables(_targets(spark, sf).select("variable").distinct(), scalars.parse_groups("Fast=1-URGENT+2-HIGH;Slow=5-LOW"))


def _origins(spark, sf):
    months = D.panel_monthly(spark, sf).select("m").distinct()
    return months.select(F.col("m").alias("origin"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m")) - 1).alias("idx"))


EVENTS = """WITH o AS (SELECT m AS origin, CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m FROM orders)),
e AS (SELECT printf('sel-%03d-o%04d', row_number() OVER (ORDER BY idx) - 1, idx) AS event_id, idx AS applies_from, CAST(coalesce(lead(idx) OVER (ORDER BY idx), (SELECT max(idx) + 1 FROM o)) - 1 AS INTEGER) AS applies_to FROM o WHERE idx % 7 = 0)"""


@query(EVENTS + "SELECT * FROM e")
def selection_events(spark, sf):
    return planning.selection_events(_origins(spark, sf), 7)


@query(EVENTS + "SELECT o.origin, o.idx, e.event_id, e.applies_from, e.applies_to FROM o JOIN e ON o.idx BETWEEN e.applies_from AND e.applies_to")
def event_of_origin(spark, sf):
    origins = _origins(spark, sf)
    return planning.event_of_origin(origins, planning.selection_events(origins, 7))


@query(EVENTS + "SELECT o.origin, o.idx, last_value(e.event_id IGNORE NULLS) OVER (ORDER BY o.idx) AS carried FROM o LEFT JOIN e ON o.idx = e.applies_from")
def carry_forward(spark, sf):
    origins = _origins(spark, sf)
    events = planning.selection_events(origins, 7)
    sparse = origins.join(events, origins.idx == events.applies_from, "left").select("origin", "idx", "event_id", F.lit(0).alias("one"))
    return planning.carry_forward(sparse, ["one"], "idx", "event_id").select("origin", "idx", "carried")


SPLITS = EVENTS.split(",\ne AS")[0] + """, c AS (SELECT idx AS cutoff FROM o WHERE idx >= 40), k AS (SELECT cutoff, unnest([0, 1, 2]) AS r FROM c),
s AS (SELECT cutoff, printf('split-o%05d', cutoff - 4 - 3 * r) AS split_id, greatest(cutoff - 4 - 3 * r - 23, 0) AS train_start, cutoff - 4 - 3 * r AS origin, round(pow(0.5, r) / 1.75, 6) AS origin_weight FROM k)"""


def _splits(spark, sf):
    cutoffs = _origins(spark, sf).filter("idx >= 40").select(F.col("idx").alias("cutoff"))
    return planning.validation_splits(cutoffs, {1: 1, 2: 2, 4: 4}, 24, 3, stride=3, window=24, decay=0.5)


@query(SPLITS + "SELECT cutoff, split_id, CAST(train_start AS INTEGER) AS train_start, CAST(origin AS INTEGER) AS train_end, CAST(origin AS INTEGER) AS origin, CAST(origin + 4 AS INTEGER) AS target_4, origin_weight FROM s")
def validation_splits(spark, sf):
    s = _splits(spark, sf)
    return rounded(s.select("cutoff", "split_id", "train_start", "train_end", "origin", F.element_at("targets", 4).alias("target_4"), "origin_weight"))


@query(SPLITS + """, planted AS (SELECT cutoff, split_id, train_start, origin, origin + CASE WHEN cutoff % 5 = 0 THEN 1 ELSE 0 END AS train_end, cutoff - CASE WHEN cutoff % 7 = 0 THEN 1 ELSE 0 END AS info_cutoff FROM s)
SELECT cutoff, split_id FROM planted WHERE train_start > train_end OR train_end > origin OR origin + 4 > info_cutoff""")
def split_leakage(spark, sf):
    """Splits that reach past their origin or their information, among planted ones."""
    late = F.col("train_end") + F.when(F.col("cutoff") % 5 == 0, 1).otherwise(0)
    early = F.col("info_cutoff") - F.when(F.col("cutoff") % 7 == 0, 1).otherwise(0)
    return checks.leaking_splits(_splits(spark, sf).withColumn("train_end", late).withColumn("info_cutoff", early)).select("cutoff", "split_id")


@query(SPLITS + ", " + D.PANEL_SQL + """, p AS (SELECT variable, m, y, CAST(row_number() OVER (PARTITION BY variable ORDER BY m) - 1 AS INTEGER) AS row_idx FROM growth)
SELECT s.split_id, s.cutoff, p.variable, count(*) AS n, round(avg(p.y), 6) AS mean, round(greatest(stddev_samp(p.y), 0.00000001), 6) AS deviation FROM s JOIN p ON p.row_idx BETWEEN s.train_start AND s.origin GROUP BY 1, 2, 3""")
def fold_standardiser(spark, sf):
    panel = D.growth(spark, sf).withColumn("row_idx", F.row_number().over(Window.partitionBy("variable").orderBy("m")) - 1)
    rows = planning.training_rows(panel, _splits(spark, sf))
    return rounded(rows.groupBy("split_id", "cutoff", "variable").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.greatest(F.stddev_samp("y"), F.lit(1e-8)).alias("deviation")))


@query(SPLITS + ", " + D.PANEL_SQL + """, p AS (SELECT variable, m, y, CAST(row_number() OVER (PARTITION BY variable ORDER BY m) - 1 AS INTEGER) AS row_idx FROM growth)
SELECT s.split_id, s.cutoff, h.horizon, p.variable, p.y AS realization FROM s CROSS JOIN (VALUES (1), (2), (4)) AS h(horizon) JOIN p ON p.row_idx = s.origin + h.horizon""")
def split_targets(spark, sf):
    panel = D.growth(spark, sf).withColumn("row_idx", F.row_number().over(Window.partitionBy("variable").orderBy("m")) - 1)
    return planning.target_rows(panel, _splits(spark, sf)).select("split_id", "cutoff", "horizon", "variable", F.col("y").alias("realization"))


@query("SELECT CAST(l AS DOUBLE) AS lam, p, CAST(a AS DOUBLE) AS alpha, CAST(k AS DOUBLE) AS kappa FROM (VALUES (0.01), (0.1), (1), (10), (100), (1000)) AS q(l) CROSS JOIN (VALUES (1), (2), (4)) AS r(p) CROSS JOIN (VALUES (0), (1), (2)) AS s(a) CROSS JOIN (VALUES (1), (2)) AS t(k)")
def candidate_grid(spark, sf):
    return planning.grid(spark).drop("candidate")


@query("SELECT CAST(last_day(d) AS DATE) AS origin FROM (SELECT unnest(range(DATE '2005-03-01', DATE '2025-01-01', INTERVAL 3 MONTH)) AS d)")
def quarter_end_calendar(spark, sf):
    return planning.month_ends(spark, "2005-03-01", "2024-12-31", 3)


def _pick(how: str):
    condition = {"most_recent": "i >= n - 6", "evenly_spaced": "i IN (SELECT CAST(round_even(k * (n - 1) / 5.0, 0) AS INTEGER) FROM (VALUES (0), (1), (2), (3), (4), (5)) AS q(k))"}[how]
    return EVENTS.split(",\ne AS")[0] + f", r AS (SELECT origin, idx AS i, count(*) OVER () AS n FROM o) SELECT origin FROM r WHERE {condition}"


@query(_pick("most_recent"))
def origins_most_recent(spark, sf):
    return selection.pick_origins(_origins(spark, sf).select("origin"), 6)


@query(_pick("evenly_spaced"))
def origins_evenly_spaced(spark, sf):
    return selection.pick_origins(_origins(spark, sf).select("origin"), 6, "evenly_spaced")


@query(EVENTS.split(",\ne AS")[0] + "SELECT origin, round(pow(0.9, row_number() OVER (ORDER BY origin DESC) - 1) / sum(pow(0.9, (SELECT max(idx) FROM o) - idx)) OVER (), 9) AS weight FROM o")
def recency_weights(spark, sf):
    whole = Window.partitionBy(F.lit(0))
    raw = F.pow(F.lit(0.9), F.row_number().over(whole.orderBy(F.desc("origin"))) - 1)
    return _origins(spark, sf).withColumn("w", raw).select("origin", F.round(F.col("w") / F.sum("w").over(whole), 9).alias("weight"))


@query()
def job_matrix(spark, sf):
    return planning.jobs(spark, {"ridge": {"scopes": list(planning.SCOPES[:4]), "variants": ["iterated", "direct"], "seeds": [0, 1]}, "bvar": {"scopes": ["pooled"], "variants": ["small", "medium"]}})


# Vintages ------------------------------------------------------------------------------------------------------------

V = D.VINTAGE_SQL


@query(V + "SELECT * FROM vintages")
def vintage_panel(spark, sf):
    return D.vintages(spark, sf)


@query(V + "SELECT obs, value FROM vintages WHERE vintage = 23988")
def vintage_selection(spark, sf):
    panel = D.vintages(spark, sf).select("series_id", F.col("vintage").alias("vintage_date"), "obs", "value")
    return vintage.at_vintage(panel, 23988).select("obs", "value")


@query(V + "SELECT obs, count(*) AS n_vintages, count(DISTINCT value) AS n_values, arg_min(value, vintage) AS first_value, arg_max(value, vintage) AS last_value FROM vintages GROUP BY 1")
def revisions(spark, sf):
    panel = D.vintages(spark, sf).select("series_id", F.col("vintage").alias("vintage_date"), F.col("obs").alias("observation_date"), "value")
    return vintage.revisions(panel).select(F.col("observation_date").alias("obs"), "n_vintages", "n_values", "first_value", "last_value")


@query(V + "SELECT obs, arg_max(value, vintage) AS value, max(vintage) AS vintage FROM vintages WHERE vintage <= 23988 GROUP BY 1")
def latest_known(spark, sf):
    panel = D.vintages(spark, sf).select("series_id", F.col("vintage").alias("vintage_date"), F.col("obs").alias("observation_date"), "value")
    return vintage.latest(panel, 23988).select(F.col("observation_date").alias("obs"), "value", F.col("vintage_date").alias("vintage"))


@query("""WITH f AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS v, CAST(o_orderdate AS DATE) AS o, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT series_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_missing, CAST(sum(CASE WHEN o > v THEN n ELSE 0 END) AS BIGINT) AS n_future, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM f GROUP BY 1""")
def vintage_violations(spark, sf):
    lines, orders = D.table(spark, sf, "lineitem"), D.table(spark, sf, "orders")
    raw = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("vintage_date"), F.col("o_orderdate").cast("date").alias("observation_date"), F.col("l_extendedprice").alias("value"))
    return checks.vintage_violations(raw)


@query("WITH " + D.PANEL_SQL + "SELECT variable AS series_id, CAST(floor(m / 3) AS INTEGER) AS quarter, CASE WHEN count(*) = 3 THEN round(avg(value), 4) END AS value, count(*) AS n_months FROM panel_m GROUP BY 1, 2")
def quarterly_resample(spark, sf):
    monthly = D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("month"), "value")
    return rounded(vintage.to_quarters(monthly, complete=True), 4)


@query("WITH " + D.PANEL_SQL + "SELECT variable AS series_id, CAST(floor(m / 3) AS INTEGER) AS quarter, arg_max(value, m) AS value, count(*) AS n_months FROM panel_m GROUP BY 1, 2")
def quarterly_last(spark, sf):
    return vintage.to_quarters(D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("month"), "value"), "last")


@query("WITH " + D.PANEL_SQL + "SELECT variable, m, y FROM growth")
def growth_rates(spark, sf):
    return D.growth(spark, sf)


RAGGED = "WITH " + D.PANEL_SQL + """, r AS (SELECT variable AS series_id, m AS period, value FROM panel_m WHERE NOT (variable = '2-HIGH' AND m < 23950) AND NOT (variable = '5-LOW' AND m > 24010)),
f AS (SELECT min(period) AS first FROM (SELECT period, count(*) AS k FROM r GROUP BY 1) WHERE k = 5)"""


def _ragged(spark, sf):
    rows = D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("period"), "value")
    return rows.filter(~((F.col("series_id") == "2-HIGH") & (F.col("period") < 23950)) & ~((F.col("series_id") == "5-LOW") & (F.col("period") > 24010)))


@query(RAGGED + "SELECT series_id, period, value, max(period) OVER (PARTITION BY series_id) AS last_period FROM r WHERE period >= (SELECT first FROM f)")
def ragged_window(spark, sf):
    return vintage.ragged_window(_ragged(spark, sf), 5)


@query("WITH " + D.PANEL_SQL + """, q AS (SELECT variable AS series_id, CAST(floor(m / 3) AS INTEGER) AS period, round(sum(value), 2) AS value FROM panel_m GROUP BY 1, 2),
r AS (SELECT * FROM q WHERE NOT (series_id = '2-HIGH' AND period < 7983) AND NOT (series_id = '5-LOW' AND period > 8003)), k AS (SELECT period FROM r GROUP BY 1 HAVING count(*) = 5)
SELECT series_id, period, value FROM r WHERE period BETWEEN (SELECT min(period) FROM k) AND (SELECT max(period) FROM k)""")
def complete_window(spark, sf):
    monthly = D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("month"), "value")
    q = rounded(vintage.to_quarters(monthly, "sum").select("series_id", F.col("quarter").alias("period"), "value"), 2)
    kept = q.filter(~((F.col("series_id") == "2-HIGH") & (F.col("period") < 7983)) & ~((F.col("series_id") == "5-LOW") & (F.col("period") > 8003)))
    return vintage.complete_window(kept, 5)


@query(RAGGED + ", s AS (SELECT series_id, unnest(range(min(period), max(period) + 1)) AS period FROM r WHERE period % 4 <> 1 GROUP BY 1) SELECT s.series_id, CAST(s.period AS INTEGER) AS period, r.value FROM s LEFT JOIN r ON r.series_id = s.series_id AND r.period = s.period AND r.period % 4 <> 1")
def calendar_alignment(spark, sf):
    return vintage.calendar(_ragged(spark, sf).filter("period % 4 <> 1"))


@query(RAGGED + """, v AS (SELECT * FROM r WHERE period >= 23980), a AS (SELECT series_id, min(period) AS anchor, arg_min(value, period) AS av FROM v GROUP BY 1)
SELECT series_id, period, round(value, 3) AS value, FALSE AS is_synthesized, CAST(NULL AS INTEGER) AS anchor_period FROM v
UNION ALL SELECT p.variable, p.m, round(a.av * p.value / q.value, 3), TRUE, a.anchor FROM panel_m p JOIN a ON a.series_id = p.variable AND p.m < a.anchor JOIN panel_m q ON q.variable = p.variable AND q.m = a.anchor""")
def backcast(spark, sf):
    reference = D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("period"), "value")
    return rounded(vintage.backcast(_ragged(spark, sf).filter("period >= 23980"), reference), 3)


@query(V + """, p AS (SELECT * FROM vintages WHERE obs >= 23940 AND NOT (vintage % 3 = 0 AND vintage > 23970 AND obs < 23955) AND NOT (vintage % 4 = 1 AND vintage > 23970 AND obs < 23949)),
f AS (SELECT vintage, min(obs) AS first, arg_min(value, obs) AS anchor FROM p GROUP BY 1),
s AS (SELECT vintage, obs, ln(value) - ln(lead(value) OVER (PARTITION BY vintage ORDER BY obs)) AS r FROM p),
a AS (SELECT vintage, anchor, CAST(unnest(range(23940, first)) AS INTEGER) AS obs FROM f WHERE first > 23940),
b AS (SELECT a.vintage, a.obs, any_value(a.anchor) AS anchor, max(s.vintage) AS reference FROM a JOIN s ON s.obs = a.obs AND s.vintage < a.vintage AND s.r IS NOT NULL GROUP BY 1, 2),
m AS (SELECT b.vintage, b.obs, b.reference, b.anchor * exp(sum(s.r) OVER (PARTITION BY b.vintage ORDER BY b.obs DESC)) AS value FROM b JOIN s ON s.vintage = b.reference AND s.obs = b.obs)
SELECT 'sales' AS series_id, vintage, obs, round(value, 3) AS value, FALSE AS is_synthesized, CAST(NULL AS INTEGER) AS reference FROM p UNION ALL SELECT 'sales', vintage, obs, round(value, 3), TRUE, reference FROM m""")
def repaired_vintages(spark, sf):
    """Short vintages filled back through a chain of earlier ones."""
    panel = D.vintages(spark, sf).filter("obs >= 23940 and not (vintage % 3 = 0 and vintage > 23970 and obs < 23955) and not (vintage % 4 = 1 and vintage > 23970 and obs < 23949)")
    out = vintage.repaired(panel.select("series_id", F.col("vintage").alias("vintage_date"), F.col("obs").alias("period"), "value"), 23940)
    return rounded(out.select("series_id", F.col("vintage_date").alias("vintage"), F.col("period").alias("obs"), "value", "is_synthesized", F.col("reference_vintage").alias("reference")), 3)


@query("WITH " + D.PANEL_SQL + """, mo AS (SELECT variable AS series_id, m AS period, value FROM panel_m WHERE variable > '2-HIGH' AND NOT (variable = '3-MEDIUM' AND m < 23947) AND NOT (variable = '5-LOW' AND m > 24010)),
qu AS (SELECT variable AS series_id, CAST(floor(m / 3) AS INTEGER) AS period, round(sum(value), 2) AS value FROM panel_m WHERE variable <= '2-HIGH' AND NOT (variable = '2-HIGH' AND m < 23944) GROUP BY 1, 2),
fm AS (SELECT min(period) AS first FROM (SELECT period FROM mo GROUP BY 1 HAVING count(*) = 3)), fq AS (SELECT min(period) AS first FROM (SELECT period FROM qu GROUP BY 1 HAVING count(*) = 2)),
e AS (SELECT greatest(CAST(ceil((SELECT first FROM fm) / 3.0) AS INTEGER), (SELECT first FROM fq)) AS first, (SELECT greatest((SELECT max(period) FROM mo), (SELECT max(period) * 3 + 2 FROM qu))) AS last),
g AS (SELECT series_id, CAST(unnest(range((SELECT first * 3 FROM e), (SELECT last + 1 FROM e))) AS INTEGER) AS period FROM (SELECT DISTINCT series_id FROM mo))
SELECT 'quarterly' AS block, series_id, period, value FROM qu WHERE period >= (SELECT first FROM e) UNION ALL SELECT 'monthly', g.series_id, g.period, mo.value FROM g LEFT JOIN mo ON mo.series_id = g.series_id AND mo.period = g.period""")
def aligned_blocks(spark, sf):
    """A quarterly and a monthly block from their common first quarter on."""
    monthly = D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("period"), "value")
    low = monthly.filter("series_id <= '2-HIGH' and not (series_id = '2-HIGH' and period < 23944)").withColumnRenamed("period", "month")
    quarterly = rounded(vintage.to_quarters(low, "sum").select("series_id", F.col("quarter").alias("period"), "value"), 2)
    high = monthly.filter("series_id > '2-HIGH' and not (series_id = '3-MEDIUM' and period < 23947) and not (series_id = '5-LOW' and period > 24010)")
    return vintage.aligned_blocks(quarterly, high, 2, 3)


@query("WITH " + D.PANEL_SQL + "SELECT variable AS series_id, m AS period, round(CASE WHEN variable <= '2-HIGH' THEN 100 * ln(value) ELSE value END, 6) AS value FROM panel_m")
def transformed_levels(spark, sf):
    levels = D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("period"), "value")
    spec = levels.select("series_id").distinct().withColumn("transform", F.when(F.col("series_id") <= "2-HIGH", "log").otherwise("lin"))
    return rounded(vintage.transformed(levels, spec))


@query("""WITH f AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS vintage_date, count(*) AS n_rows, count(*) FILTER (l_discount > 0.09) AS n_fallback, count(DISTINCT l_linestatus) AS n_hashes FROM lineitem GROUP BY 1, 2) SELECT * FROM f WHERE n_fallback > 0 OR n_hashes <> 1""")
def provenance_violations(spark, sf):
    lines = D.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("vintage_date"), F.when(F.col("l_discount") > 0.09, "True").otherwise("0").alias("fallback_used"), F.col("l_linestatus").alias("data_sha256"))
    return checks.provenance_violations(lines)


@query("""WITH o AS (SELECT DISTINCT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter FROM orders) SELECT a.quarter, a.quarter + 2 AS vintage_quarter, b.quarter IS NOT NULL AS found FROM o a LEFT JOIN o b ON b.quarter = a.quarter + 2""")
def inner_vintages(spark, sf):
    q = D.table(spark, sf, "orders").select(periods.quarter_ordinal(F.col("o_orderdate")).alias("quarter")).distinct()
    return vintage.inner_vintages(q, q, 2).select("quarter", "vintage_quarter", "found")


@query("""WITH q AS (SELECT o_orderpriority AS variable, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter FROM orders GROUP BY 1, 2)
SELECT variable, quarter, CAST(floor(quarter / 4) AS BIGINT) || 'Q' || (quarter % 4 + 1) AS label, h AS horizon, quarter + h - 1 AS target_quarter, quarter + h AS target_after_data FROM q CROSS JOIN (VALUES (1), (2), (4)) AS r(h)""")
def target_quarters(spark, sf):
    q = D.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("variable"), periods.quarter_ordinal(F.col("o_orderdate")).alias("quarter")).distinct()
    rows = q.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in D.HORIZONS])))
    return rows.select("variable", "quarter", periods.quarter_label(F.col("quarter")).alias("label"), "horizon", periods.target_quarter(F.col("quarter"), F.col("horizon")).alias("target_quarter"), periods.target_quarter(F.col("quarter"), F.col("horizon"), False).alias("target_after_data"))


@query("""SELECT o_orderkey, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS quarter_end, CASE month(o_orderdate) % 3 WHEN 1 THEN '+0 months' WHEN 2 THEN '+1 month' ELSE '+2 months' END AS origin_group,
  CAST((floor((year(o_orderdate) * 12 + month(o_orderdate) - 1) / 3) + 2 - 1) * 3 + 2 - (year(o_orderdate) * 12 + month(o_orderdate) - 1) AS INTEGER) AS required_months FROM orders""")
def origin_calendar(spark, sf):
    day = F.col("o_orderdate")
    return D.table(spark, sf, "orders").select("o_orderkey", periods.month_end(day).alias("month_end"), periods.quarter_end(day).alias("quarter_end"), periods.origin_group(F.month(day)).alias("origin_group"), periods.required_months(periods.month_ordinal(day), F.lit(2)).cast("int").alias("required_months"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linestatus = 'O' THEN 100 * ln(l_extendedprice) ELSE l_extendedprice END, 6) AS transformed, round(CASE WHEN l_linestatus = 'O' THEN exp(l_discount) ELSE 100 * l_discount END, 6) AS inverted,
  CASE WHEN l_tax > 0 AND l_tax < 0.08 THEN round(-ln((0.08 - l_tax) / l_tax), 6) + 0.0 END AS unbounded, round(0.0001 + 4.9999 / (1 + exp(-l_discount)), 6) AS boxed,
  round(CASE WHEN l_returnflag = 'A' THEN 0.0 WHEN l_returnflag = 'N' THEN pow(l_linenumber, 1.5) ELSE 2.0 * pow(l_linenumber, 1.5) END, 6) AS penalty, greatest(l_discount, 0.05) AS floored, l_discount < 0.05 AS was_floored FROM lineitem""")
def scalar_transforms(spark, sf):
    lines = D.table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "log").otherwise("lin")
    role = F.when(F.col("l_returnflag") == "A", "intercept").when(F.col("l_returnflag") == "N", "own").otherwise("cross")
    value, low = scalars.floored(F.col("l_discount"), 0.05)
    return rounded(
        lines.select(
            "l_orderkey", "l_linenumber", scalars.transform(F.col("l_extendedprice"), kind).alias("transformed"), scalars.inverse_transform(F.col("l_discount"), F.when(kind == "log", 0).otherwise(1)).alias("inverted"),
            scalars.to_unbounded(F.col("l_tax"), F.lit(0.0), F.lit(0.08)).alias("unbounded"), scalars.to_box(F.col("l_discount"), F.lit(0.0001), F.lit(5.0)).alias("boxed"),
            scalars.penalty_weight(role, F.col("l_linenumber").cast("double"), F.lit(1.5), F.lit(2.0)).alias("penalty"), value.alias("floored"), low.alias("was_floored"),
        )
    )


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, printf('split-o%05d', p_partkey) AS split_id, TRY_CAST(regexp_extract('h' || p_size || 'q', '^h(\\d+)q$', 1) AS INTEGER) AS horizon FROM part""")
def identifiers(spark, sf):
    p = D.table(spark, sf, "part")
    return p.select("p_partkey", scalars.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), scalars.split_id(F.col("p_partkey")).alias("split_id"), scalars.horizon_number(F.concat(F.lit("h"), F.col("p_size").cast("string"), F.lit("q"))).alias("horizon"))


# Failures, costs, metadata -------------------------------------------------------------------------------------------

#: A text for each class, the class that it has, and what the text would be if a later word counted first.
FAILURE_TEXTS = [
    ("KeyboardInterrupt: stopped", "cancelled"), ("non-finite forecast, nan", "nonfinite_forecast"), ("LinAlgError: Singular matrix", "numerical"), ("got NaN", "numerical"), ("ZeroDivision: divide by zero", "numerical"),
    ("No such file or directory", "runtime"), ("column missing", "missing_input"), ("vintage not found", "missing_input"), ("ImportError: scipy", "dependency"), ("Permission denied", "permission"), ("TimeoutError: 30 s", "timeout"),
    ("scale requires a benchmark", "invalid_configuration"), ("shape mismatch", "invalid_configuration"), ("forecast infeasible", "forecast_invalid"), ("forecast came out odd", "runtime"), ("odd thing", "runtime"), ("   ", "unknown"), (None, "unknown"),
]
_CASES = " ".join(f"WHEN {k} THEN " + ("NULL" if t is None else f"'{t}'") for k, (t, _) in enumerate(FAILURE_TEXTS))
_CLASSES = " ".join(f"WHEN {k} THEN '{c}'" for k, (_, c) in enumerate(FAILURE_TEXTS))
FAIL = f"""WITH f AS (SELECT event_type AS model, CASE user_id % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'forecast' END AS stage, CASE event_id % {len(FAILURE_TEXTS)} {_CASES} END AS error, CASE event_id % {len(FAILURE_TEXTS)} {_CLASSES} END AS class FROM events)"""


def _failures(spark, sf):
    texts = literal_table(spark, [(k, t) for k, (t, _) in enumerate(FAILURE_TEXTS)], "k int, error string")
    e = D.table(spark, sf, "events").select("event_type", "user_id", F.pmod("event_id", F.lit(len(FAILURE_TEXTS))).cast("int").alias("k")).join(F.broadcast(texts), "k")  # the texts above
    return e.select(F.col("event_type").alias("model"), F.when(F.col("user_id") % 3 == 0, "fit").when(F.col("user_id") % 3 == 1, "forecast").alias("stage"), "error")


@query(FAIL + "SELECT model, coalesce(stage, 'unknown') AS stage, count(*) AS n_failures FROM f GROUP BY 1, 2 UNION ALL SELECT model, '__total__', count(*) FROM f GROUP BY 1")
def failure_summary(spark, sf):
    return metrics.failure_summary(_failures(spark, sf))


@query(FAIL + "SELECT stage, class AS category, count(*) AS n_failures FROM f GROUP BY 1, 2")
def failures_by_category(spark, sf):
    return metrics.failures_by_category(_failures(spark, sf))


@query("""SELECT CAST(event_id AS VARCHAR) AS model, TRY_CAST(coalesce(json_extract_string(props, '$.wall_seconds'), json_extract_string(props, '$.k'), json_extract_string(props, '$.v')) AS DOUBLE) AS seconds, CAST(NULL AS DOUBLE) AS peak FROM events""")
def computational_cost(spark, sf):
    meta = D.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("model"), "props")
    return metrics.computational_cost(meta, "props", {"seconds": ["wall_seconds", "k", "v"], "peak": []})


@query("SELECT 'c_mktsegment' AS field, count(DISTINCT c_mktsegment) AS n_values FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer")
def metadata_compatibility(spark, sf):
    rows = D.table(spark, sf, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"), F.lit("one").alias("same"))
    return checks.conflicting_values(rows, ["c_mktsegment", "c_nationkey", "same"])


@query("""SELECT n_regionkey, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(sha256(n_nationkey || '|' || n_name), 1, 15)) AS BIGINT)) AS VARCHAR) AS content_sum FROM nation GROUP BY 1""")
def content_hash(spark, sf):
    return checks.content_hash(D.table(spark, sf, "nation"), ["n_nationkey", "n_name"], ["n_regionkey"])


@query("WITH m AS (SELECT DISTINCT c_mktsegment AS model FROM customer) SELECT model, row_number() OVER (ORDER BY CASE model WHEN 'MACHINERY' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END, model) AS position FROM m")
def ordered_models(spark, sf):
    out = metrics.ordered_models(D.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("model")), ["MACHINERY", "AUTOMOBILE"])
    return out.select("model", F.col("position").cast("long").alias("position"))


@query("""SELECT l_returnflag AS variable, l_linestatus AS status, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.16), 4) AS p16, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
  round(quantile_cont(l_extendedprice, 0.84), 4) AS p84, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, count(*) AS n_draws FROM lineitem GROUP BY 1, 2""")
def draw_summaries(spark, sf):
    draws = D.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("variable"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("value"))
    return rounded(vintage.summaries(draws, ["variable", "status"]), 4)


@query("WITH " + D.PANEL_SQL + "SELECT variable, m, y AS l0, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lead(y, 3) OVER w AS target_4 FROM growth WINDOW w AS (PARTITION BY variable ORDER BY m)")
def lag_design(spark, sf):
    w = Window.partitionBy("variable").orderBy("m")
    return D.growth(spark, sf).select("variable", "m", F.col("y").alias("l0"), F.lag("y", 1).over(w).alias("l1"), F.lag("y", 2).over(w).alias("l2"), F.lead("y", 3).over(w).alias("target_4"))


# Draws, audits, metadata of runs --------------------------------------------------------------------------------------

GROWING = ["1-URGENT", "2-HIGH"]
PATHS = "WITH " + D.PANEL_SQL + """, d AS (SELECT unnest(range(5)) AS draw), parts AS (
  SELECT draw, variable, m AS period, value, 'history' AS segment, 0 AS place FROM panel_m, d WHERE m <= 23990
  UNION ALL SELECT draw, variable, m, value * (1 + CAST(draw AS DOUBLE) / 300), 'nowcast', 1 FROM panel_m, d WHERE m IN (23990, 23991)
  UNION ALL SELECT draw, variable, m, value * (1 + CAST(draw - 2 AS DOUBLE) / 90), 'forecast', 2 FROM panel_m, d WHERE m >= 23991),
paths AS (SELECT CAST(draw AS INTEGER) AS draw, variable, period, value, segment FROM parts QUALIFY place = min(place) OVER (PARTITION BY draw, variable, period))"""


def _paths(spark, sf):
    known = D.panel_monthly(spark, sf).select("variable", F.col("m").alias("period"), "value")
    numbers = literal_table(spark, [(d,) for d in range(5)], "draw int")
    each = known.join(F.broadcast(numbers))  # five numbers
    nowcast = each.filter("period in (23990, 23991)").withColumn("value", F.col("value") * (1 + F.col("draw") / 300.0))
    ahead = each.filter("period >= 23991").withColumn("value", F.col("value") * (1 + (F.col("draw") - 2) / 90.0))
    return draws.stacked([("history", known.filter("period <= 23990")), ("nowcast", nowcast), ("forecast", ahead)], numbers)


@query(PATHS + "SELECT draw, variable, period, round(value, 4) AS value, segment FROM paths")
def draw_paths(spark, sf):
    return rounded(_paths(spark, sf), 4)


@query(PATHS + """, m AS (SELECT variable, period, draw, value, CASE WHEN variable IN ('1-URGENT', '2-HIGH') THEN 100 * (ln(value) - lag(ln(value)) OVER (PARTITION BY draw, variable ORDER BY period)) ELSE value END AS metric FROM paths),
l AS (SELECT variable, period, 'level' AS kind, value AS x FROM m UNION ALL SELECT variable, period, 'metric', metric FROM m)
SELECT variable, period, kind, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.16), 4) AS p16, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.84), 4) AS p84, round(quantile_cont(x, 0.95), 4) AS p95, count(x) AS n_draws FROM l GROUP BY 1, 2, 3""")
def path_summaries(spark, sf):
    return rounded(draws.path_summaries(_paths(spark, sf), GROWING), 4)


@query(V + """, k AS (SELECT series_id, obs AS period, value, 100 * (ln(value) - lag(ln(value)) OVER (ORDER BY obs)) AS growth FROM vintages WHERE vintage = 23988 AND value IS NOT NULL) SELECT series_id, period, round(value, 4) AS value, round(growth, 4) + 0.0 AS metric FROM k""")
def scoring_frame(spark, sf):
    panel = D.vintages(spark, sf).select("series_id", F.col("vintage").alias("vintage_date"), F.col("obs").alias("period"), "value")
    return rounded(draws.scoring_frame(panel, 23988, ["sales"]), 4)


@query(C + """, r AS (SELECT p.model, p.variable, p.horizon, count(*) AS n_rows, count(s.origin) AS n_common_rows FROM panel p LEFT JOIN shared s ON p.variable = s.variable AND p.horizon = s.horizon AND p.origin = s.origin GROUP BY 1, 2, 3),
k AS (SELECT p.variable, p.horizon, count(DISTINCT s.origin) AS n_common_keys, count(DISTINCT p.origin) - count(DISTINCT s.origin) AS n_excluded_keys FROM panel p LEFT JOIN shared s ON p.variable = s.variable AND p.horizon = s.horizon AND p.origin = s.origin GROUP BY 1, 2),
t AS (SELECT model, sum(n_rows) AS n_rows, sum(n_common_rows) AS n_common_rows, sum(n_common_keys) AS n_common_keys, sum(n_excluded_keys) AS n_excluded_keys FROM r JOIN k USING (variable, horizon) GROUP BY 1
  UNION ALL SELECT '__all__', (SELECT sum(n_rows) FROM r), (SELECT sum(n_common_rows) FROM r), (SELECT sum(n_common_keys) FROM k), (SELECT sum(n_excluded_keys) FROM k))
SELECT model, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_common_rows AS BIGINT) AS n_common_rows, CAST(n_common_keys AS BIGINT) AS n_common_keys, CAST(n_excluded_keys AS BIGINT) AS n_excluded_keys, round(n_common_rows / n_rows, 6) AS coverage FROM t""")
def common_sample_totals(spark, sf):
    return rounded(pairing.sample_totals(D.panel(spark, sf)))


@query(PAIRED + """SELECT model, variable, horizon, CAST(origin AS VARCHAR) AS forecast_origin, status, CAST(NULL AS VARCHAR) AS error FROM status WHERE status <> 'common'
UNION ALL SELECT DISTINCT model, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), CAST(origin AS VARCHAR), 'run_failure', 'failed at ' || origin FROM panel WHERE model = 'mean_5' AND origin % 11 = 0""")
def exclusion_audit_with_failures(spark, sf):
    panel = D.panel(spark, sf)
    failed = panel.filter("model = 'mean_5' and origin_ord % 11 = 0").select("model", "forecast_origin", F.concat(F.lit("failed at "), "forecast_origin").alias("failure")).distinct()
    return pairing.audit(panel, "no_change", failed).select("model", "variable", "horizon", "forecast_origin", "status", F.col("failure").alias("error"))


@query(C + "SELECT model, variable, horizon, round(sqrt(avg(error * error)), 6) AS rmse, count(*) AS n FROM panel GROUP BY 1, 2, 3")
def unpaired_rmse(spark, sf):
    return rounded(metrics.unpaired_rmse(D.panel(spark, sf)))


@query(C + "SELECT model, variable, horizon, count(*) AS n FROM panel WHERE scope = 'variable' AND horizon IN (1, 4) GROUP BY 1, 2, 3")
def tag_lookup(spark, sf):
    return pairing.tagged(D.panel(spark, sf), scope="variable", size=None, horizon=[1, 4]).groupBy("model", "variable", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query(C + "SELECT model || '/h' || horizon || 'q' AS model, count(*) AS n FROM panel WHERE horizon <> 2 GROUP BY 1 UNION ALL SELECT model, count(*) FROM panel WHERE horizon = 2 GROUP BY 1")
def model_variants(spark, sf):
    h = F.when(F.col("horizon") != 2, F.concat(F.lit("h"), F.col("horizon").cast("string"), F.lit("q")))
    return metrics.variants(D.panel(spark, sf).withColumn("optimization_horizon", h)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'region' AS field, count(DISTINCT n_regionkey) AS n_values, 0 AS n_missing FROM nation UNION ALL SELECT 'commit', 0, CAST(count(*) AS INTEGER) FROM nation UNION ALL SELECT 'key', count(DISTINCT n_nationkey) FILTER (n_nationkey > 20), CAST(count(*) FILTER (n_nationkey <= 20) AS INTEGER) FROM nation")
def metadata_findings(spark, sf):
    runs = D.table(spark, sf, "nation").withColumn("late", F.when(F.col("n_nationkey") > 20, F.col("n_nationkey")))
    found = checks.compatible_metadata(runs, {"region": ["regionkey", "n_regionkey"], "commit": ["repository_commit"], "key": ["late"]}, "n_name")
    return found.select("field", "n_values", F.size("missing").alias("n_missing"))


@query(SPLITS + "SELECT cutoff, split_id, CAST(cutoff AS INTEGER) AS vintage, CAST(origin AS INTEGER) AS strict_vintage FROM s")
def split_vintages(spark, sf):
    splits = _splits(spark, sf)
    strict = planning.split_vintages(splits, "strict_inner_real_time").select("cutoff", "split_id", F.col("vintage").alias("strict_vintage"))
    return planning.split_vintages(splits).select("cutoff", "split_id", "vintage").join(strict, ["cutoff", "split_id"])


@query()
def chosen_jobs(spark, sf):
    return planning.chosen_jobs(job_matrix(spark, sf), [0, 2], family="ridge", scope=["pooled", "horizon"])


# Kernels -------------------------------------------------------------------------------------------------------------


def growth_study(spark, sf, **settings) -> tuple[DataFrame, experiment.Study]:
    """(row_idx, variable, value) of every series over the months that all series have, and a study of all of them.

    Orders without a priority belong to no series.
    """
    g = hold(D.growth(spark, sf).filter("variable is not null"))  # the names and the rows read it
    variables = tuple(r.variable for r in g.select("variable").distinct().orderBy("variable").collect())  # columns of one regression
    whole = g.groupBy("m").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(variables)).select("m", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m")) - 1).alias("row_idx"))
    return g.join(whole, "m").select("row_idx", "variable", F.col("y").alias("value")), experiment.Study(variables=variables, **settings)


#: The whole grid of the ridge studies, 108 candidates.
GRID = {"lam": (0.0, 0.01, 0.1, 1.0, 10.0, 100.0), "p": (1, 2, 4), "alpha": (0.0, 1.0, 2.0), "kappa": (1.0, 2.0)}


@query()
def ridge_scope_selections(spark, sf):
    return experiment.scope_grid(*growth_study(spark, sf, **GRID))[0]


@query()
def ridge_scope_forecasts(spark, sf):
    return experiment.scope_grid(*growth_study(spark, sf, **GRID))[1]


@query()
def ridge_direct_forecasts(spark, sf):
    return experiment.scope_grid(*growth_study(spark, sf, every=2, method="direct", **GRID))[1]


@query()
def benchmark_forecasts(spark, sf):
    return experiment.benchmarks(*growth_study(spark, sf), experiment.BENCHMARKS)


def predictive_summaries(draws: DataFrame) -> DataFrame:
    return vintage.summaries(draws, ["origin", "variable", "horizon", "error"])


@query()
def bayesian_forecasts(spark, sf):
    """2,000 predictive draws an origin after 1,000 discarded; a failing origin is a row with its error and no draws."""
    return predictive_summaries(experiment.bayesian_forecasts(*growth_study(spark, sf), draws=2000, hyperparameters="metropolis"))


@query()
def bayesian_scope_forecasts(spark, sf):
    """The same nested plan with another kernel: shrinkage lam, unit-root weight alpha and sum-of-coefficients weight kappa."""
    settings = {"scopes": ("pooled", "variable"), "lam": (0.1, 0.2, 0.5), "p": (2,), "alpha": (1.0, 5.0), "kappa": (1.0,), "kernel": bvar.forecast}
    return experiment.scope_grid(*growth_study(spark, sf, **settings))[1]


def search_study(spark, sf) -> tuple[DataFrame, experiment.Study]:
    """What the searches below run on: all series, four outer origins, three horizons, two scopes."""
    return growth_study(spark, sf, n_outer=4, horizons=(1, 2, 4), scopes=("pooled", "variable"))


@query()
def bvar_candidate_losses(spark, sf):
    """Losses of 24 candidates (shrinkages and residual scales) in the inner splits of each cell."""
    return search.scope_search(*search_study(spark, sf), search.SearchSpace("full"))[0]


@query()
def bvar_selections(spark, sf):
    """The candidate of greatest evidence for each cell, with its coordinates."""
    return search.scope_search(*search_study(spark, sf), search.SearchSpace("reduced"), by_evidence=True)[1].drop("point")


@query()
def bvar_scope_forecasts(spark, sf):
    """Forecasts with each cell's choice, of its own targets and, as diagnostics, of all others."""
    return search.scope_search(*search_study(spark, sf), search.SearchSpace("custom", free=("lam",), fixed={"mu": 2.0}), diagnostics=True)[2]


@query()
def generated_draws(spark, sf):
    """Summaries of simulated paths at two sets of hyperparameters, one of which can't be run."""
    panel, study = growth_study(spark, sf)
    last = panel.agg(F.max("row_idx")).first()[0]
    rows = [(f"{name}-{o}", o, params) for o in (last - 8, last - 4) for name, params in (("near", {"lam": 0.2, "theta": 1.0, "mu": 1.0}), ("same", {"mu": 1.0, "theta": 1.0, "lam": 0.2}), ("outside", {"lam": 0.2, "psi": 99.0}))]
    tasks = spark.createDataFrame(rows, "task string, origin int, params map<string,double>")
    made = search.generated(panel, tasks, search.bvar_generator(), list(study.variables), list(study.horizons))
    return vintage.summaries(made, ["task", "origin", "variable", "horizon", "error"])


# Everything that a comparison reports, in one table: its parts by name.
@query()
def comparison_overview(spark, sf):
    return report.overview(report.comparison(hold(D.panel(spark, sf)), "no_change"))


@query("WITH h AS (SELECT DISTINCT 'h' || p_size || 'q' AS label, p_size FROM part) SELECT label, row_number() OVER (ORDER BY p_size) AS position FROM h")
def horizon_order(spark, sf):
    labels = D.table(spark, sf, "part").select(F.concat(F.lit("h"), F.col("p_size").cast("string"), F.lit("q")).alias("label")).distinct()
    return labels.select("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(scalars.horizon_number(F.col("label")))).cast("long").alias("position"))


@query("WITH " + D.PANEL_SQL + """, q AS (SELECT 'quarterly' AS block, variable, CAST(floor(m / 3) AS INTEGER) AS quarter, arg_max(value, m) AS value FROM panel_m WHERE variable <= '2-HIGH' GROUP BY 2, 3),
a AS (SELECT 'monthly' AS block, variable, CAST(floor(m / 3) AS INTEGER) AS quarter, CASE WHEN count(*) = 3 THEN round(avg(value), 4) END AS value FROM panel_m WHERE variable > '2-HIGH' GROUP BY 2, 3) SELECT * FROM q UNION ALL SELECT * FROM a""")
def evaluation_frame(spark, sf):
    """Quarterly series by their last month, monthly ones by the mean of complete quarters, in one long frame."""
    monthly = D.panel_monthly(spark, sf).select(F.col("variable").alias("series_id"), F.col("m").alias("month"), "value")
    q = vintage.to_quarters(monthly.filter("series_id <= '2-HIGH'"), "last").withColumn("block", F.lit("quarterly"))
    a = vintage.to_quarters(monthly.filter("series_id > '2-HIGH'"), "mean", complete=True).withColumn("block", F.lit("monthly"))
    return q.unionByName(a).select("block", F.col("series_id").alias("variable"), "quarter", F.when(F.col("block") == "quarterly", F.col("value")).otherwise(F.round("value", 4)).alias("value"))
