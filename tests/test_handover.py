"""Ranges that hand their state over against one range over all, in pandas."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators.calendar import TradingCalendar
from barloom.plans.engine import Engine
from barloom.plans.features import FEATURE_NAMES, features
from barloom.plans.handover import RangeState, range_state
from barloom.plans.models import Ridge
from support import pandas_features, random_bars
from test_features import close

NAMES = [*FEATURE_NAMES, "bret12", "cx_bret12", "log_trade_imbema5"]
DAYS = [20240102 + d for d in range(8)]
RANGES = [DAYS[:3], DAYS[3:4], DAYS[4:]]


@pytest.fixture(scope="module")
def bars():
    pdf = random_bars(symbols=4, days=8, per_day=7, seed=3, gaps=0.15)
    idle = (pdf["symbol"] == 90000001) & pdf["date"].isin(RANGES[1])  # does not trade in the second range
    late = (pdf["symbol"] == 90000002) & ~pdf["date"].isin(RANGES[2])  # appears in the third
    empty = pdf["symbol"] == 90000003
    pdf.loc[empty & pdf["date"].isin(DAYS[:4]), ["midpx", "tradeBuyQty"]] = np.nan  # nothing to hand over at first
    return pdf[~idle & ~late]


def of(pdf, days):
    return pdf[pdf["date"].isin(days)]


@pytest.mark.parametrize("scope", ["symbol", "universe"])
@pytest.mark.parametrize("max_rows", [4_000_000, 20, 5])
def test_ranges_go_on_as_one(spark, bars, scope, max_rows, tmp_path):
    state, seen = None, []
    for days in RANGES:
        seen += days
        part = spark.createDataFrame(of(bars, days))
        got = features(part, NAMES, mean_scope=scope, max_rows=max_rows, state=state).toPandas()
        want = of(pandas_features(of(bars, seen), scope), days)
        close(got, want, [*NAMES, "fret12"], rtol=1e-10, atol=1e-10)
        range_state(part, state, scope, max_rows).write(str(tmp_path), days[-1])
        state = RangeState.read(spark, str(tmp_path), days[-1])
    assert state.mean_scope == scope and state.series.count() == 4


def test_state_of_one_range_equals_that_of_two(spark, bars, tmp_path):
    first = range_state(spark.createDataFrame(of(bars, DAYS[:4])))
    first.write(str(tmp_path), DAYS[3])
    both = range_state(spark.createDataFrame(of(bars, DAYS[4:])), RangeState.read(spark, str(tmp_path), DAYS[3]))
    whole = range_state(spark.createDataFrame(bars))
    for made, want in ((both.series, whole.series), (both.means, whole.means)):
        keys = [c for c in ("symbol", "interval") if c in made.columns]
        a, b = (df.drop("bars").toPandas().sort_values(keys).reset_index(drop=True)[sorted(made.drop("bars").columns)] for df in (made, want))
        pd.testing.assert_frame_equal(a, b, rtol=1e-10, atol=1e-12)
    last = {r["symbol"]: [x["interval"] for x in r["bars"]] for r in both.series.collect()}
    assert last == {r["symbol"]: [x["interval"] for x in r["bars"]] for r in whole.series.collect()} and max(map(len, last.values())) == 12


def test_long_series_with_a_long_gap(spark):
    rng = np.random.default_rng(2)
    n = 5000
    pdf = random_bars(symbols=1, days=1, per_day=n, seed=1, gaps=0, infs=0, shuffle=False)
    pdf["interval"] = np.arange(n)
    pdf["date"] = (20240102 + np.arange(n) // 2600).astype("int32")
    pdf.loc[1500:2900, "midpx"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "tradeBuyQty"] = np.nan
    names = ["ema_midpx", "ema_trade_imb", "trade_imbema5", "lagret12", "momentum_midpx"]
    first, second = pdf[pdf["date"] == 20240102], pdf[pdf["date"] == 20240103]
    for max_rows in (4_000_000, 700):
        state = range_state(spark.createDataFrame(first), max_rows=max_rows)
        got = features(spark.createDataFrame(second), names, max_rows=max_rows, state=state).toPandas()
        want = pandas_features(pdf)
        close(got, want[want["date"] == 20240103], names, rtol=1e-9, atol=1e-9)


def test_blocked_plan_has_no_python(spark, bars):
    plan = features(spark.createDataFrame(bars), ["ema_midpx"], max_rows=20)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_engine_hands_over(spark, bars, tmp_path):
    cal = TradingCalendar.from_column(spark.createDataFrame(bars[["date"]]), "date")
    names = ["ema_midpx", "lagret12"]
    engine = Engine(spark.createDataFrame(bars), cal, model=Ridge(names), plan=lambda b, state=None: features(b, names, state=state),
                    state_root=str(tmp_path / "states"))
    for _ in range(2):  # a range that is run again starts from the same state
        engine.hand_over(DAYS[0], DAYS[3])
    want = pandas_features(bars)
    close(engine.features(DAYS[4], DAYS[7]).toPandas(), of(want, DAYS[4:]), names)
    cold = of(pandas_features(of(bars, DAYS[5:])), DAYS[5:])
    close(engine.features(DAYS[5], DAYS[7]).toPandas(), cold, names)  # no state as of the day before: windows start empty
    assert engine.fit(DAYS[0], DAYS[3]).eval(DAYS[4], DAYS[7]).first()["n"] == len(of(bars, DAYS[4:]))
    with pytest.raises(ValueError, match="warm-up"):
        Engine(engine.bars, cal, warmup_days=1, state_root="x")


def test_scopes_do_not_mix(spark, bars):
    part = spark.createDataFrame(bars)
    with pytest.raises(ValueError, match="scope"):
        features(part, ["ob_imb0"], mean_scope="universe", state=range_state(part))
