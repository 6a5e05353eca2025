import numpy as np
import pytest

from barloom.operators.calendar import TradingCalendar
from barloom.plans.engine import Engine
from barloom.sources.bars import (
    bars_between, bars_of_symbol, load_day, load_days, open_bars, read_day_file, write_by_date,
)
from barloom.sources.events import bars_from_events, labelled_bars
from barloom.sources.schema import duplicate_keys, require_unique_keys
from support import random_bars

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bars") / "table")
    bars = spark.createDataFrame(random_bars(symbols=3, days=5, per_day=10)).selectExpr("*", "1 as extra")
    write_by_date(bars, root)
    return root, bars


@pytest.fixture(scope="module")
def cal(stored):
    return TradingCalendar.from_column(stored[1].where("date <> 20240104"), "date")


def test_round_trip(spark, stored):
    root, bars = stored
    got = open_bars(spark, root)
    assert got.columns[:3] == ["symbol", "interval", "date"] and "extra" in got.columns
    assert got.select(bars.columns).exceptAll(bars).count() == 0 and got.count() == bars.count()


def test_days(spark, stored, cal):
    root, bars = stored
    assert load_day(spark, root, cal, "20240103").count() == 30
    assert load_days(spark, root, cal, [20240102, 20240105]).count() == 60
    with pytest.raises(ValueError, match="no dates"):
        load_days(spark, root, cal, [])
    with pytest.raises(ValueError, match="not trading days"):
        load_day(spark, root, cal, 20240104)
    assert bars_between(open_bars(spark, root), cal, 20240103, 20240105).count() == 60


def test_pruning_and_pushdown(spark, stored, cal):
    bars = open_bars(spark, stored[0])
    plan = bars_between(bars, cal, 20240103, 20240105).select("midpx")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "ReadSchema: struct<midpx:double>" in plan
    plan = bars_of_symbol(bars, 90000001)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,90000001)" in plan


def test_bad_directories(spark, stored, cal, tmp_path):
    with pytest.raises(ValueError, match="bar directory"):
        open_bars(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        Engine.open(spark, str(tmp_path / "none"), cal)
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="lack the columns"):
        open_bars(spark, str(tmp_path / "other"))


def test_day_file(spark, stored, tmp_path):
    path = str(tmp_path / "20240103.parquet")
    stored[1].where("date = 20240103").drop("date").write.parquet(path)
    df = read_day_file(spark, path)
    assert {r[0] for r in df.select("date").distinct().collect()} == {20240103} and df.count() == 30
    assert df.columns[:3] == ["symbol", "interval", "date"]
    with pytest.raises(ValueError):
        read_day_file(spark, str(tmp_path / "nodate"))


def test_events_to_bars(spark):
    events = spark.read.parquet(EVENTS)
    bars = labelled_bars(events)
    assert duplicate_keys(bars).count() == 0
    p = bars.orderBy("symbol", "date", "interval").toPandas()
    assert len(p) == bars_from_events(events).count()
    want = p.groupby("symbol")["midpx"].shift(-12) / p["midpx"] - 1
    np.testing.assert_allclose(p["fret12"].astype(float), want, rtol=1e-12)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (1, 2, 4)], "symbol long, date int, interval long")
    assert [tuple(r) for r in duplicate_keys(df).collect()] == [(1, 2, 3, 2)]
    with pytest.raises(ValueError, match="duplicate key"):
        require_unique_keys(df)
    assert require_unique_keys(df.distinct()).count() == 2
