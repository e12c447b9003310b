"""Forecast-evaluation tables derived from an order book, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods
from ..operators import vintage

HORIZONS = (1, 2, 4)
MODELS = {"no_change": "pooled", "seasonal_naive": "horizon", "mean_3": "variable", "mean_5": "variable_horizon"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, m, value): order value by priority and month; decimal sums are exact in any order."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.col("o_orderpriority").alias("variable"), periods.month_ordinal(F.col("o_orderdate")).alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, m, y): monthly growth, rounded."""
    return vintage.growth(panel_monthly(spark, sf_dir), ["variable"], "m").select("variable", "m", F.round("growth", 6).alias("y")).filter("y is not null")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four forecasters at three horizons: (model, variable, origin, target, horizon, forecast, actual, error)."""
    w = Window.partitionBy("variable").orderBy("m")
    rn = F.row_number().over(w)
    mean = lambda k: F.when(rn >= k, F.avg("y").over(w.rowsBetween(1 - k, 0)))
    cases = [F.struct(F.lit(h).alias("horizon"), F.lead("y", h).over(w).alias("actual"), F.lag("y", 12 - h).over(w).alias("seasonal")) for h in HORIZONS]
    wide = growth(spark, sf_dir).select("variable", "m", "y", mean(3).alias("m3"), mean(5).alias("m5"), F.array(*cases).alias("c"))
    long = wide.select("variable", "m", "y", "m3", "m5", F.explode("c").alias("c")).filter("c.actual is not null")
    each = [("no_change", "y"), ("seasonal_naive", "c.seasonal"), ("mean_3", "m3"), ("mean_5", "m5")]
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("f")) for n, c in each]))
    rows = long.select("variable", "m", "c.horizon", "c.actual", models.alias("x")).filter("x.f is not null")
    return rows.select("x.model", "variable", F.col("m").alias("origin"), (F.col("m") + F.col("horizon")).alias("target"), "horizon", F.round("x.f", 6).alias("forecast"), "actual", F.round(F.round("x.f", 6) - F.col("actual"), 6).alias("error"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical panel of these forecasts; two models lack some keys."""
    rows = forecasts(spark, sf_dir).filter(~((F.col("model") == "mean_3") & (F.col("origin") % 5 == 0)) & ~((F.col("model") == "mean_5") & (F.col("origin") % 7 == 0)))
    scope = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])
    return rows.select(
        "model", F.lit("average").alias("family"), F.lit(None).cast("string").alias("size"), scope[F.col("model")].alias("scope"), F.lit("once").alias("selection"), F.lit("iterated").alias("forecast_method"),
        periods.origin_group(F.pmod(F.col("origin"), F.lit(12)) + 1).alias("group"), F.col("origin").cast("string").alias("forecast_origin"), F.col("origin").cast("long").alias("origin_ord"),
        F.col("target").cast("string").alias("target"), "variable", "horizon", "forecast", "actual", "error",
    )


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitemporal panel (series_id, vintage, obs, value): what is known of each order month, by the month of shipping."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    facts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("l_shipdate") >= F.col("o_orderdate"))
    monthly = facts.groupBy(periods.month_ordinal(F.col("o_orderdate")).alias("obs"), periods.month_ordinal(F.col("l_shipdate")).alias("available")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("part"))
    # A running sum over months of availability, carried to the vintages without news.
    last = monthly.agg(F.max("available").alias("last"))
    grid = monthly.groupBy("obs").agg(F.min("available").alias("first")).join(F.broadcast(last)).select("obs", F.explode(F.sequence("first", "last")).alias("vintage"))  # one row
    filled = grid.join(monthly, (grid.obs == monthly.obs) & (grid.vintage == monthly.available), "left").select(grid.obs, "vintage", F.coalesce("part", F.lit(0).cast("decimal(18,2)")).alias("part"))
    w = Window.partitionBy("obs").orderBy("vintage").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(F.lit("sales").alias("series_id"), "vintage", "obs", F.sum("part").over(w).cast("double").alias("value"))


PANEL_SQL = """panel_m AS (
  SELECT o_orderpriority AS variable, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2),
growth AS (SELECT * FROM (SELECT variable, m, round(100 * (ln(value) - lag(ln(value)) OVER (PARTITION BY variable ORDER BY m)), 6) AS y FROM panel_m) WHERE y IS NOT NULL)"""

FORECASTS_SQL = (
    "WITH "
    + PANEL_SQL
    + """,
lagged AS (
  SELECT variable, m, y, row_number() OVER w AS rn, avg(y) OVER (PARTITION BY variable ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, avg(y) OVER (PARTITION BY variable ORDER BY m ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5,
    lead(y, 1) OVER w AS a1, lead(y, 2) OVER w AS a2, lead(y, 4) OVER w AS a4, lag(y, 11) OVER w AS s1, lag(y, 10) OVER w AS s2, lag(y, 8) OVER w AS s4
  FROM growth WINDOW w AS (PARTITION BY variable ORDER BY m)),
raw AS (
  SELECT model, variable, m AS origin, m + h AS target, h AS horizon,
    CASE model WHEN 'no_change' THEN y WHEN 'seasonal_naive' THEN (CASE h WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s4 END) WHEN 'mean_3' THEN (CASE WHEN rn >= 3 THEN m3 END) ELSE (CASE WHEN rn >= 5 THEN m5 END) END AS f,
    CASE h WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE a4 END AS actual
  FROM lagged CROSS JOIN (VALUES ('no_change'), ('seasonal_naive'), ('mean_3'), ('mean_5')) AS q(model) CROSS JOIN (VALUES (1), (2), (4)) AS r(h)),
forecasts AS (SELECT model, variable, origin, target, horizon, round(f, 6) AS forecast, actual, round(round(f, 6) - actual, 6) AS error FROM raw WHERE f IS NOT NULL AND actual IS NOT NULL)"""
)

CANONICAL_SQL = (
    FORECASTS_SQL
    + """,
panel AS (
  SELECT *, CASE model WHEN 'no_change' THEN 'pooled' WHEN 'seasonal_naive' THEN 'horizon' WHEN 'mean_3' THEN 'variable' ELSE 'variable_horizon' END AS scope,
    CASE (origin % 12 + 1) % 3 WHEN 1 THEN '+0 months' WHEN 2 THEN '+1 month' ELSE '+2 months' END AS grp
  FROM forecasts WHERE NOT (model = 'mean_3' AND origin % 5 = 0) AND NOT (model = 'mean_5' AND origin % 7 = 0)),
shared AS (
  SELECT k.variable, k.horizon, k.origin FROM (SELECT variable, horizon, origin, count(DISTINCT model) AS have FROM panel GROUP BY 1, 2, 3) k
  JOIN (SELECT variable, horizon, count(DISTINCT model) AS every FROM panel GROUP BY 1, 2) c ON k.variable = c.variable AND k.horizon = c.horizon AND have = every),
common AS (SELECT p.* FROM panel p JOIN shared s ON p.variable = s.variable AND p.horizon = s.horizon AND p.origin = s.origin)"""
)

VINTAGE_SQL = """WITH facts AS (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS obs, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS available, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1, 2),
spans AS (SELECT obs, min(available) AS first, (SELECT max(available) FROM facts) AS last FROM facts GROUP BY 1),
grid AS (SELECT obs, CAST(unnest(range(first, last + 1)) AS INTEGER) AS vintage FROM spans),
vintages AS (SELECT 'sales' AS series_id, g.vintage, g.obs, CAST(sum(f.part) AS DOUBLE) AS value FROM grid g JOIN facts f ON f.obs = g.obs AND f.available <= g.vintage GROUP BY g.obs, g.vintage)"""
