import pytest
from pyspark.sql import functions as F

from tideline.__main__ import main
from tideline.operators import vintage

from .conftest import SMALL


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "dm_tests" in capsys.readouterr().out.split()
    assert main(["list", "--sql"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "candidate_grid", "--tables", SMALL, "--out", f"{tmp_path}/g"]) == 0
    assert spark.read.parquet(f"{tmp_path}/g").count() == 108
    with pytest.raises(SystemExit):
        main(["run", "nothing", "--tables", SMALL, "--out", "x"])


def test_repair_needs_an_earlier_vintage(spark):
    rows = [("s", 1, 5, 10.0), ("s", 1, 6, 20.0), ("s", 2, 3, 1.0), ("s", 2, 4, 2.0), ("s", 2, 5, 4.0), ("s", 3, 5, 8.0), ("s", 4, 4, 6.0), ("s", 4, 5, 9.0), ("s", 5, 5, 1.0)]
    panel = spark.createDataFrame(rows, "series_id string, vintage_date int, period int, value double")
    got = {(r.vintage_date, r.period): (round(r.value, 9), r.reference_vintage) for r in vintage.repaired(panel.filter("vintage_date > 1"), 3).collect()}
    assert got[3, 3] == (2.0, 2) and got[3, 4] == (4.0, 2) and got[4, 3] == (3.0, 2)
    assert got[5, 4] == (round(6 / 9, 9), 4) and got[5, 3] == (round(6 / 9 / 2, 9), 2) and got[5, 5] == (1.0, None)
    with pytest.raises(Exception, match="no earlier vintage"):
        vintage.repaired(panel, 3).collect()


def test_sketched_quantiles(spark):
    draws = spark.range(1, 100_001).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("value"))
    exact, near = vintage.summaries(draws, ["k"]).first(), vintage.summaries(draws, ["k"], accuracy=1000).first()
    assert all(abs(exact[c] - near[c]) <= 200 for c in ("p05", "p16", "median", "p84", "p95")) and near.n_draws == 100_000
