"""Bars stored in buckets: the plan over them, and the same features."""

import pytest

from barloom.plans.features import FEATURE_NAMES, features
from barloom.sources.layout import open_layout, write_layout
from support import pandas_features, random_bars
from test_features import close


@pytest.fixture(scope="module")
def pdf():
    return random_bars(symbols=5, days=6, per_day=12, seed=6)


def jobs_of(spark, action):
    spark.sparkContext.setJobGroup("watched", "watched")
    try:
        made = action()
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup("watched"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_exchange_and_no_job_before_its_own(spark, pdf, tmp_path):
    bars = spark.createDataFrame(pdf)
    stored = write_layout(bars, str(tmp_path / "t"), buckets=4)
    assert stored.layout is None and stored.buckets == 4
    made, jobs = jobs_of(spark, stored.features)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert jobs == 0 and "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert "Exchange" in features(bars, max_rows=None)._jdf.queryExecution().executedPlan().toString()
    close(made.toPandas(), pandas_features(pdf), [*FEATURE_NAMES, "fret12"])


def test_another_session_declares_it_again(spark, pdf, tmp_path):
    root = str(tmp_path / "t")
    write_layout(spark.createDataFrame(pdf), root, buckets=3)
    other = spark.newSession()
    for table in spark.catalog.listTables():
        if table.name.startswith("bars_"):
            spark.sql(f"drop table {table.name}")
    again = open_layout(other, root)
    made = again.features(["ema_midpx", "lagret12"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    close(made.toPandas(), pandas_features(pdf), ["ema_midpx", "lagret12"])
    with pytest.raises(ValueError, match="no stored bars"):
        open_layout(spark, str(tmp_path / "none"))


def test_cut_symbols_keep_their_blocks(spark, pdf, tmp_path):
    root = str(tmp_path / "t")
    write_layout(spark.createDataFrame(pdf), root, max_rows=30)
    stored, jobs = jobs_of(spark, lambda: open_layout(spark, root))
    assert stored.layout.blocks == 5 * 3
    close(stored.features().toPandas(), pandas_features(pdf), [*FEATURE_NAMES, "fret12"])
    plan = stored.features(["ema_midpx"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" not in plan  # blocks are dealt anew, so all tasks share the scan of a big bucket


def test_writing_again_replaces(spark, pdf, tmp_path):
    root = str(tmp_path / "t")
    bars = spark.createDataFrame(pdf)
    write_layout(bars, root, max_rows=30)
    stored = write_layout(bars.where("symbol < 90000002"), root, buckets=2)
    assert stored.bars.count() == 2 * 72 and stored.layout is None and stored.features(["ob_imb0"]).count() == 144
