"""Holes between days, columns by name, days written again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.calendar import TradingCalendar
from barloom.plans.engine import Engine
from barloom.plans.models import Ridge
from barloom.plans.features import features
from barloom.sources.bars import bars_between, bars_on, load_day, load_days, open_bars, write_by_date
from barloom.sources.days import SchemaConflict, absent_days, day_folders, read_by_name, schema_report
from support import random_bars

DAYS = [20240102, 20240103, 20240104, 20240105, 20240108]


@pytest.fixture(scope="module")
def cal(spark):
    return TradingCalendar.from_column(spark.createDataFrame([(d,) for d in DAYS], "d int"), "d")


@pytest.fixture(scope="module")
def holed(spark, tmp_path_factory):
    """20240104 is a trading day without a file."""
    root = str(tmp_path_factory.mktemp("holed") / "t")
    write_by_date(spark.createDataFrame(random_bars(symbols=3, days=5, per_day=10)).where("date in (20240102, 20240103, 20240105)"), root)
    return root


def test_a_day_without_a_file_is_named(spark, holed, cal):
    bars = open_bars(spark, holed)
    assert sorted(day_folders(bars)) == [20240102, 20240103, 20240105]
    with pytest.raises(ValueError, match=r"no data for the trading days \[20240104\]"):
        load_day(spark, holed, cal, 20240104)
    with pytest.raises(ValueError, match=r"\[20240104, 20240108\]"):
        load_days(spark, holed, cal, [20240103, 20240104, 20240108])
    with pytest.raises(ValueError, match=r"\[20240104\]"):
        bars_between(bars, cal, 20240103, 20240105)
    with pytest.raises(ValueError, match=r"\[20240104\]"):
        bars_between(bars.where("symbol = 90000001"), cal, 20240101, 20240107)  # a filtered table still knows its files
    assert bars_between(bars, cal, 20240102, 20240103).count() == 60
    assert load_day(spark, holed, cal, 20240105).count() == 30


def test_the_engine_names_them(spark, holed, cal):
    names = ["ob_imb0", "trade_imb"]
    engine = Engine.open(spark, holed, cal, model=Ridge(names), plan=lambda b: features(b, names))
    with pytest.raises(ValueError, match=r"\[20240104\]"):
        engine.fit(20240102, 20240105)
    with pytest.raises(ValueError, match=r"\[20240108\]"):
        engine.fit(20240102, 20240103).eval(20240105, 20240108)


def test_other_frames_are_looked_at_if_asked(spark, cal):
    bars = spark.createDataFrame(random_bars(symbols=2, days=5, per_day=4)).where("date <> 20240103")
    assert day_folders(bars) is None and absent_days(bars, DAYS) == [] and absent_days(bars, DAYS, look=True) == [20240103, 20240108]
    assert bars_between(bars, cal, 20240102, 20240104).count() == 16
    with pytest.raises(ValueError, match=r"\[20240103\]"):
        bars_between(bars, cal, 20240102, 20240104, look=True)
    with pytest.raises(ValueError, match=r"\[20240103\]"):
        bars_on(bars, cal, [20240102, 20240103], look=True)
    names = ["ob_imb0"]
    engine = Engine(bars, cal, model=Ridge(names), plan=lambda b: features(b, names), look_for_days=True)
    with pytest.raises(ValueError, match=r"\[20240103\]"):
        engine.features(20240102, 20240104)


def test_no_data_is_read_for_it(spark, holed, cal, tmp_path):
    """The files may be unreadable: only their names count."""
    for day in (20240102, 20240104):
        (tmp_path / f"date={day}").mkdir()
        (tmp_path / f"date={day}" / "part-0.parquet").write_bytes(b"not parquet")
    frame = spark.read.schema("symbol bigint").parquet(str(tmp_path))
    assert absent_days(frame, [20240102, 20240103, 20240104]) == [20240103]


# -- columns by name ----------------------------------------------------------------------


def parts():
    base = dict(symbol=[90000001, 90000002], interval=[93000, 93100])
    return {
        20240102: pd.DataFrame({**base, "a": np.array([1, 2], "int32"), "b": [1.5, 2.5]}),
        20240103: pd.DataFrame({**base, "a": np.array([3, 1 << 40], "int64"), "extra": ["x", "y"], "b": [3.5, 4.5]}),
        20240104: pd.DataFrame({**base, "b": np.array([0.5, 0.25], "float32"), "a": [0.5, 6.0], "late": [1, 2]}),
    }


def stored(tables, root):
    for day, pdf in tables.items():
        (root / f"date={day}").mkdir(parents=True)
        pdf.to_parquet(root / f"date={day}" / "part-0.parquet")
    return str(root)


def test_columns_are_united_as_concat_does(spark, tmp_path):
    tables = parts()
    got = read_by_name(spark, stored(tables, tmp_path / "t"))
    want = pd.concat([p.assign(date=d) for d, p in tables.items()], ignore_index=True)
    assert got.columns == ["symbol", "interval", "a", "b", "extra", "late", "date"]
    assert dict(got.dtypes)["a"] == dict(got.dtypes)["b"] == "double" and dict(got.dtypes)["late"] == "bigint"
    pdf = got.orderBy("date", "symbol").toPandas()
    for c in ("symbol", "interval", "a", "b", "late", "date"):
        np.testing.assert_array_equal(pdf[c].astype(float), want[c].astype(float))
    assert [x if isinstance(x, str) else None for x in pdf["extra"]] == [None, None, "x", "y", None, None]


def test_agreeing_days_stay_one_scan_and_the_rest_is_pruned(spark, tmp_path):
    tables = parts()
    root = stored({d: tables[d] for d in (20240102,)} | {20240105: tables[20240102].assign(more=1.0)}, tmp_path / "a")
    one = read_by_name(spark, root)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and one.columns == ["symbol", "interval", "a", "b", "more", "date"]
    mixed = read_by_name(spark, stored(tables, tmp_path / "b")).where("date = 20240103").select("a")
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") == plan.count("FileScan") == 3
    assert [r[0] for r in mixed.orderBy("a").collect()] == [3.0, float(1 << 40)]


def test_types_without_a_common_one_are_an_error(spark, tmp_path):
    tables = parts()
    tables[20240105] = tables[20240102].assign(b=["one", "two"])
    root = stored(tables, tmp_path / "t")
    with pytest.raises(SchemaConflict, match="column b is double in 20240102 and string in 20240105"):
        read_by_name(spark, root)
    with pytest.raises(ValueError, match="column b"):
        open_bars(spark, root)


def test_the_report_tells_the_differences(spark, tmp_path):
    rows = {(r["column"], r["dtype"]): tuple(r)[2:] for r in schema_report(spark, stored(parts(), tmp_path / "t")).collect()}
    assert rows[("a", "int")] == (1, 20240102, 20240102, 0) and rows[("a", "double")] == (1, 20240104, 20240104, 0)
    assert rows[("extra", "string")] == (1, 20240103, 20240103, 2) and rows[("symbol", "bigint")] == (3, 20240102, 20240104, 0)


def test_open_bars_unites_days(spark, tmp_path):
    root = str(tmp_path / "t")
    bars = spark.createDataFrame(random_bars(symbols=2, days=3, per_day=5))
    write_by_date(bars.where("date <= 20240103"), root)
    write_by_date(bars.where("date > 20240103").withColumn("quality", F.lit("late")), root, mode="append")
    got = open_bars(spark, root)
    assert "quality" in got.columns and got.where("quality is null").count() == 20 and got.where("quality = 'late'").count() == 10


# -- days written again -------------------------------------------------------------------


def test_a_day_is_replaced_and_others_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    bars = spark.createDataFrame(random_bars(symbols=3, days=4, per_day=6))
    write_by_date(bars, root)
    rows = lambda: sorted((r["date"], r["symbol"], repr(r)) for r in open_bars(spark, root).select(bars.columns).collect())
    before, kept = rows(), (tmp_path / "t" / "date=20240103")
    stamp = {f.name: f.stat().st_mtime_ns for f in kept.iterdir()}
    day = bars.where("date = 20240102")
    for _ in range(2):
        write_by_date(day, root, mode="overwrite")
        assert rows() == before
    assert {f.name: f.stat().st_mtime_ns for f in kept.iterdir()} == stamp
    write_by_date(day.where("symbol = 90000001"), root, mode="overwrite")
    assert rows() == [r for r in before if r[0] != 20240102 or r[1] == 90000001]
    write_by_date(bars.where("date = 20240199"), root, mode="overwrite")  # no rows: no day is touched
    assert len(rows()) == len(before) - 12
    write_by_date(open_bars(spark, root).where("date = 20240104").withColumn("midpx", F.lit(1.0)), root, mode="overwrite")  # of itself
    assert len(rows()) == len(before) - 12 and {r[0] for r in open_bars(spark, root).where("date = 20240104").select("midpx").collect()} == {1.0}
    write_by_date(day, root, mode="replace_all")
    assert sorted(day_folders(open_bars(spark, root))) == [20240102]
