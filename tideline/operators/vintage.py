"""Bitemporal panels: (series_id, vintage_date, observation_date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DataError


def at_vintage(panel: DataFrame, vintage, series: list[str] | None = None) -> DataFrame:
    """What was known at one vintage; the filter reaches the scan."""
    out = panel.filter(F.col("vintage_date") == vintage)
    return out.filter(F.col("series_id").isin(series)) if series else out


def complete_window(levels: DataFrame, n_series: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows (series_id, period, value) of periods in which all ``n_series`` are observed, from the first such period on.

    ``start`` must be that first period, if given, and no period between the
    first and the last complete one may be incomplete; either is an error in
    the rows themselves (raised where they are read).
    """
    span = levels.filter((F.col("period") >= start) if start is not None else F.lit(True)).filter((F.col("period") <= end) if end is not None else F.lit(True))
    complete = span.groupBy("period").agg(F.count("value").alias("k")).filter(F.col("k") == n_series)
    edges = complete.agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.lit(1)).alias("n"))
    whole = (F.col("n") == F.col("last") - F.col("first") + 1) & (F.col("first") == start if start is not None else F.lit(True))
    checked = edges.withColumn("ok", F.when(F.col("n") == 0, True).when(whole, True).otherwise(F.raise_error(F.lit("window starts late or has a gap")).cast("boolean")))
    return span.join(F.broadcast(checked.filter("ok")), F.col("period").between(F.col("first"), F.col("last"))).select("series_id", "period", "value")  # one row


def ragged_window(levels: DataFrame, n_series: int) -> DataFrame:
    """From the first fully observed period on; each series may lack values at its end only."""
    first = levels.groupBy("period").agg(F.count("value").alias("k")).filter(F.col("k") == n_series).agg(F.min("period").alias("first"))
    last = levels.groupBy("series_id").agg(F.max(F.when(F.col("value").isNotNull(), F.col("period"))).alias("last_period"))
    inside = levels.join(F.broadcast(first), F.col("period") >= F.col("first")).join(last, "series_id").filter(F.col("period") <= F.col("last_period"))  # one row
    checked = F.when(F.col("value").isNull(), F.raise_error(F.lit("gap inside a series")).cast("double")).otherwise(F.col("value"))
    return inside.select("series_id", "period", checked.alias("value"), "last_period")


def calendar(levels: DataFrame) -> DataFrame:
    """Every period of a series between its first and last one; unobserved ones are null."""
    span = levels.groupBy("series_id").agg(F.explode(F.sequence(F.min("period"), F.max("period"))).alias("period"))
    return span.join(levels, ["series_id", "period"], "left")


def to_quarters(monthly: DataFrame, how: str = "mean", complete: bool = False) -> DataFrame:
    """(series_id, month ordinal, value) to quarters: mean, last or sum; ``complete`` wants three months."""
    value = {"mean": F.avg("value"), "sum": F.sum("value"), "last": F.max_by("value", "month")}[how]
    n = F.count("value")
    return monthly.groupBy("series_id", F.floor(F.col("month") / F.lit(3.0)).cast("int").alias("quarter")).agg((F.when(n == 3, value) if complete else value).alias("value"), n.alias("n_months"))


def growth(levels: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """100 times the first difference of logarithms; a level that isn't positive raises."""
    log = F.when(F.col(value) <= 0, F.raise_error(F.lit("level is not positive")).cast("double")).otherwise(F.ln(F.col(value)))
    return levels.withColumn("_l", log).withColumn("growth", 100 * (F.col("_l") - F.lag("_l").over(Window.partitionBy(*by).orderBy(order)))).drop("_l")


def backcast(vintage: DataFrame, reference: DataFrame) -> DataFrame:
    """Values before a vintage's first observation, from a reference's growth.

    Both: (series_id, period, value). Going back from the anchor (the first
    period that both have), each step divides by the reference's growth; a step
    whose growth is unknown, zero or infinite holds the value.
    """
    anchor = vintage.filter("value is not null").groupBy("series_id").agg(F.min_by(F.struct("period", "value"), "period").alias("a")).select("series_id", F.col("a.period").alias("anchor"), F.col("a.value").alias("anchor_value"))
    ahead = Window.partitionBy("series_id").orderBy("period")
    step = reference.withColumn("_next", F.lead("value").over(ahead))
    ratio = F.when((F.col("value") > 0) & (F.col("_next") > 0), F.ln(F.col("value")) - F.ln(F.col("_next"))).otherwise(0.0)
    back = step.join(anchor, "series_id").filter("period < anchor").withColumn("_r", ratio)
    total = F.sum("_r").over(Window.partitionBy("series_id").orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, 0))
    made = back.select("series_id", "period", (F.col("anchor_value") * F.exp(total)).alias("value"), F.lit(True).alias("is_synthesized"), F.col("anchor").alias("anchor_period"))
    return vintage.select("series_id", "period", "value").withColumn("is_synthesized", F.lit(False)).withColumn("anchor_period", F.lit(None).cast("int")).unionByName(made)


def repaired(panel: DataFrame, start: int) -> DataFrame:
    """Vintages that begin after ``start`` filled back to it: (series_id, vintage_date, period, value, is_synthesized, reference_vintage).

    Each step back takes the growth of the newest earlier vintage that itself
    observes both of its ends, so repaired vintages are references for later
    ones without a loop over vintages; a step whose growth is unknown holds the
    value. A period that no earlier vintage reaches is an error.
    """
    own = panel.filter("value is not null").filter(F.col("period") >= start)
    ahead = Window.partitionBy("series_id", "vintage_date").orderBy("period")
    after = F.lead("value").over(ahead)
    steps = own.withColumn("_next", F.when(F.lead("period").over(ahead) == F.col("period") + 1, after)).withColumn("_r", F.when(F.col("_next").isNotNull(), F.when((F.col("value") > 0) & (F.col("_next") > 0), F.ln("value") - F.ln("_next")).otherwise(0.0)))
    firsts = own.groupBy("series_id", "vintage_date").agg(F.min("period").alias("first"), F.min_by("value", "period").alias("anchor"))
    asked = firsts.filter(F.col("first") > start).select("series_id", "vintage_date", F.explode(F.sequence(F.lit(start), F.col("first") - 1)).alias("period"), "anchor")
    known = steps.filter("_r is not null").select("series_id", "vintage_date", "period", F.lit(None).cast("double").alias("anchor"), F.struct("_r", F.col("vintage_date").alias("v")).alias("step"))
    both = known.unionByName(asked, allowMissingColumns=True)
    newest = F.last("step", ignorenulls=True).over(Window.partitionBy("series_id", "period").orderBy("vintage_date").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("step", newest).filter("anchor is not null")
    rate = F.coalesce("step._r", F.raise_error(F.concat(F.lit("no earlier vintage reaches period "), F.col("period").cast("string"))).cast("double"))
    total = F.sum(rate).over(Window.partitionBy("series_id", "vintage_date").orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, 0))
    made = found.select("series_id", "vintage_date", "period", (F.col("anchor") * F.exp(total)).alias("value"), F.lit(True).alias("is_synthesized"), F.col("step.v").alias("reference_vintage"))
    return own.select("series_id", "vintage_date", "period", "value", F.lit(False).alias("is_synthesized"), F.lit(None).cast(dict(own.dtypes)["vintage_date"]).alias("reference_vintage")).unionByName(made)


def aligned_blocks(quarterly: DataFrame, monthly: DataFrame, n_quarterly: int, n_monthly: int) -> DataFrame:
    """Both blocks from one first quarter on: (block, series_id, period, value).

    It is the later of the first whole quarter of complete months and the first
    complete quarter. Months run on, null where unobserved, to the last release
    or the end of the last quarter, whichever is later.
    """
    q, m = ragged_window(quarterly, n_quarterly), ragged_window(monthly, n_monthly)
    edges = m.agg(F.ceil(F.min("period") / F.lit(3.0)).cast("int").alias("_mq"), F.max("last_period").alias("_released")).crossJoin(F.broadcast(q.agg(F.min("period").alias("_qq"), F.max("period").alias("_ql"))))  # one row each
    edges = edges.select(F.greatest("_mq", "_qq").alias("first"), "_ql", F.greatest(F.col("_released"), F.col("_ql") * 3 + 2).alias("end"))
    enough = F.when((F.col("_ql") >= F.col("first")) & (F.col("end") >= F.col("first") * 3 + 2), F.col("first")).otherwise(F.raise_error(F.lit("too little history after alignment")).cast("int"))
    edges = F.broadcast(edges.withColumn("first", enough))  # one row
    kept = q.join(edges, F.col("period") >= F.col("first")).select(F.lit("quarterly").alias("block"), "series_id", "period", "value")
    grid = m.select("series_id").distinct().join(edges).select("series_id", F.explode(F.sequence(F.col("first") * 3, F.col("end"))).alias("period"))
    return kept.unionByName(grid.join(m.select("series_id", "period", "value"), ["series_id", "period"], "left").select(F.lit("monthly").alias("block"), "series_id", "period", "value"))


def transformed(levels: DataFrame, spec: DataFrame) -> DataFrame:
    """``value`` of every series by its own transform; ``spec``: (series_id, transform). A series without one is an error."""
    from ..functions.scalars import transform

    joined = levels.join(spec.select("series_id", "transform"), "series_id", "left")
    kind = F.coalesce("transform", F.raise_error(F.concat(F.lit("no transform for "), F.col("series_id"))).cast("string"))
    return joined.withColumn("value", transform(F.col("value"), kind)).drop("transform")


def inner_vintages(origins: DataFrame, vintages: DataFrame, lag_quarters: int) -> DataFrame:
    """Each inner quarter (column ``quarter``) with the vintage at the end of quarter + lag; without one an error row."""
    need = origins.withColumn("vintage_quarter", F.col("quarter") + lag_quarters)
    have = vintages.select(F.col("quarter").alias("vintage_quarter")).distinct().withColumn("found", F.lit(True))
    return need.join(have, "vintage_quarter", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_defaults(panel: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Provenance columns: added where absent, nulls filled with their default."""
    for name, default in defaults.items():
        panel = panel.withColumn(name, F.coalesce(F.col(name), default) if name in panel.columns else default)
    return panel


def revisions(panel: DataFrame) -> DataFrame:
    """For each series and observation: vintages, first and last value."""
    return panel.groupBy("series_id", "observation_date").agg(F.count(F.lit(1)).alias("n_vintages"), F.countDistinct("value").alias("n_values"), F.min_by("value", "vintage_date").alias("first_value"), F.max_by("value", "vintage_date").alias("last_value"))


def latest(panel: DataFrame, not_after=None) -> DataFrame:
    """Each observation's value in its newest vintage."""
    if not_after is not None:
        panel = panel.filter(F.col("vintage_date") <= not_after)
    return panel.groupBy("series_id", "observation_date").agg(F.max_by("value", "vintage_date").alias("value"), F.max("vintage_date").alias("vintage_date"))


def assert_point_in_time(panel: DataFrame) -> None:
    from .checks import enforce, vintage_violations

    enforce(vintage_violations(panel).filter("n_missing > 0 or n_future > 0 or n_repeated > 0"), "vintage panel")


def summaries(draws: DataFrame, by: list[str], value: str = "value", accuracy: int | None = None) -> DataFrame:
    """Mean and quantiles over draws; growth is taken inside each draw before.

    Quantiles are exact and interpolated, for which a group's distinct values
    meet in one task: right for draws, whose number a parameter sets. With
    ``accuracy`` they are sketched instead, in bounded memory whatever the
    group's rows, and their ranks are off by one in ``accuracy`` at most.
    """
    places = F.array(*[F.lit(x) for x in (0.05, 0.16, 0.5, 0.84, 0.95)])
    q = F.percentile(value, places) if accuracy is None else F.percentile_approx(value, places, accuracy)
    return draws.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("_q"), F.count(value).alias("n_draws")).select(*by, "mean", *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("p05", "p16", "median", "p84", "p95"))], "n_draws")


def require_variables(levels: DataFrame, wanted: list[str]) -> None:
    have = {r[0] for r in levels.filter(F.col("series_id").isin(wanted)).select("series_id").distinct().collect()}  # at most the wanted ones
    if missing := [w for w in wanted if w not in have]:
        raise DataError(f"no series {', '.join(missing)}")
