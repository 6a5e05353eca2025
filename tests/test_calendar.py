import bisect

import pytest
from pyspark.sql import functions as F

from barloom.operators.calendar import TradingCalendar

DAYS = [20230103, 20230104, 20230105, 20230106, 20230109, 20230120, 20230130, 20230131, 20231228, 20231229]
PROBES = [20221231, 20230102, 20230103, 20230104, 20230107, 20230108, 20230109, 20230121, 20230129, 20230130, 20231228,
          20231229, 20231230, 20240101, 20240105, 19000101, 99991231]


@pytest.fixture(scope="module")
def cal(spark):
    return TradingCalendar.from_column(spark.createDataFrame([(d,) for d in DAYS + DAYS[:3]], "d int"), "d")


@pytest.fixture(scope="module")
def probes(spark):
    return spark.createDataFrame([(p,) for p in PROBES], "date int")


def one(df, out):
    return {r["date"]: r[out] for r in df.collect()}


def many(df, out):
    got = {}
    for r in df.collect():
        got.setdefault(r["date"], []).append(r[out])
    return {k: sorted(v) for k, v in got.items()}


def lo(d):
    return bisect.bisect_left(DAYS, d)


def hi(d):
    return bisect.bisect_right(DAYS, d)


def at(i):
    return DAYS[i] if 0 <= i < len(DAYS) else None


def test_days(cal):
    assert [tuple(r) for r in cal.days.orderBy("idx").collect()] == [(d, i) for i, d in enumerate(DAYS)]


def test_single_lookups(cal, probes):
    assert one(cal.is_trading_day(probes), "is_trading_day") == {p: p in DAYS for p in PROBES}
    assert one(cal.to_trading_day(probes), "trading_day") == {p: at(lo(p)) for p in PROBES}
    assert one(cal.next(probes), "next_day") == {p: at(hi(p)) for p in PROBES}
    assert one(cal.prev(probes), "prev_day") == {p: at(lo(p) - 1) for p in PROBES}


@pytest.mark.parametrize("n", [-30, -3, -2, -1, 0, 1, 2, 5, 40])
def test_shift(cal, probes, n):
    assert one(cal.shift(probes, n), "shifted_day") == {p: at(lo(p) + n) if lo(p) else None for p in PROBES}


@pytest.mark.parametrize("n", [1, 3, 5, 40])
def test_lists(cal, probes, n):
    want = {p: DAYS[max(lo(p) - n, 0):lo(p)] for p in PROBES}
    assert many(cal.prevn(probes, n), "prev_day") == {p: v for p, v in want.items() if v}
    want = {p: DAYS[hi(p):hi(p) + n] for p in PROBES}
    assert many(cal.nextn(probes, n), "next_day") == {p: v for p, v in want.items() if v}


def test_string_dates_and_null(cal, spark):
    df = spark.createDataFrame([("20230107",), (None,)], "date string")
    assert one(cal.next(df), "next_day") == {"20230107": 20230109, None: None}
    assert one(cal.is_trading_day(df), "is_trading_day") == {"20230107": False, None: False}


def test_range(cal):
    assert cal.range_list(20230104, "20230109") == [20230104, 20230105, 20230106, 20230109]
    assert cal.range_list(20230121, 20230129) == []
    assert cal.range(20230105, 20230104).count() == 0
    with pytest.raises(ValueError):
        cal.range_list(20230105, 20230104)
    with pytest.raises(ValueError):
        cal.range_list(20240101, 20240105)
    assert cal.days_before(20230109, 2) == [20230105, 20230106]
    assert cal.days_before(20230103, 2) == []


def test_bad_counts(cal, probes):
    for call in (lambda: cal.shift(probes, 1.5), lambda: cal.prevn(probes, 0), lambda: cal.nextn(probes, "2")):
        with pytest.raises(ValueError):
            call()


def test_from_text(spark, tmp_path):
    path = tmp_path / "calendar"
    path.write_text("20230104\n20230103\n\n20230105\n20230104\n")
    got = TradingCalendar.from_text(spark, str(path))
    assert [r[0] for r in got.days.orderBy("idx").collect()] == [20230103, 20230104, 20230105]


def test_lookup_is_one_broadcast_join(cal, spark):
    facts = spark.range(100).select((F.col("id") + 20230101).cast("int").alias("date"))
    plan = cal.next(facts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
