import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.plans.features import BASELINE_NAMES, FEATURE_NAMES, INTERMEDIATE_NAMES, baseline_features, feature_names, features
from support import pandas_features, random_bars

KEY = ["symbol", "date", "interval"]


def close(got, want, names, rtol=1e-9, atol=1e-9):
    got = got.sort_values(KEY).reset_index(drop=True)
    want = want.sort_values(KEY).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[KEY].astype("int64"), want[KEY].astype("int64"))
    for n in names:
        # pandas updates its rolling moments online and is the noisy side after a jump
        tol = 1e-3 if "kurt" in n or "skew" in n else 1e-6 if "std" in n or "volatility" in n else atol
        np.testing.assert_allclose(got[n].to_numpy(), want[n].to_numpy(), rtol=max(rtol, tol if tol > atol else 0), atol=tol, err_msg=n)


@pytest.fixture(scope="module")
def bars():
    return random_bars()


@pytest.fixture(scope="module")
def sbars(spark, bars):
    return spark.createDataFrame(bars)


def test_names_are_the_62(spark):
    assert len(FEATURE_NAMES) == len(set(FEATURE_NAMES)) == 62
    assert feature_names() == list(FEATURE_NAMES)


def test_all_features_match_pandas(sbars, bars):
    names = [*FEATURE_NAMES, *INTERMEDIATE_NAMES]
    got = features(sbars, names)
    assert got.columns == [*KEY, *names, "fret12"]
    close(got.toPandas(), pandas_features(bars), [*names, "fret12"])


@pytest.mark.parametrize("max_rows", [7, 40, 100])
def test_blocks_give_the_same(sbars, bars, max_rows):
    names = [*FEATURE_NAMES, "bret12", "cx_bret12"]
    got = features(sbars, names, max_rows=max_rows)
    close(got.toPandas(), pandas_features(bars), [*names, "fret12"])


def test_blocks_within_one_day(spark):
    bars = random_bars(symbols=2, days=2, per_day=200, seed=3)
    bars.loc[bars["symbol"] == 90000001, "date"] = 20240102  # keys stay unique: drop the copies
    bars = bars.drop_duplicates(KEY)
    got = features(spark.createDataFrame(bars), max_rows=60)
    close(got.toPandas(), pandas_features(bars), [*FEATURE_NAMES, "fret12"])


@pytest.mark.parametrize("max_rows", [10**6, 90])
def test_universe_mean(sbars, bars, max_rows):
    got = features(sbars, ["lagret12"], mean_scope="universe", max_rows=max_rows)
    close(got.toPandas(), pandas_features(bars, "universe"), ["lagret12"])


def test_label_drop(sbars, bars):
    got = features(sbars, ["ob_imb0", "ema_midpx"], label_null="drop").toPandas()
    finite = np.isfinite(bars["fret12"])
    assert len(got) == finite.sum()
    kept = bars[finite][KEY].astype("int64")
    want = pandas_features(bars).merge(kept, on=KEY)
    close(got, want, ["ob_imb0", "ema_midpx", "fret12"])


def test_no_label_column(sbars):
    assert features(sbars.drop("fret12"), ["ob_imb0"]).columns == [*KEY, "ob_imb0"]


def test_errors(sbars):
    with pytest.raises(ValueError, match="unknown features"):
        features(sbars, ["nope"])
    with pytest.raises(ValueError, match="lack the columns"):
        features(sbars.drop("midpx"))
    with pytest.raises(ValueError):
        features(sbars, mean_scope="day")


def test_one_exchange_three_sorts(sbars):
    plan = features(sbars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 3


def test_subset_drops_the_scans(sbars):
    plan = features(sbars, ["ob_imb0", "ratio_high_low"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_baseline(sbars, bars):
    df = bars.sort_values(KEY).reset_index(drop=True).replace([np.inf, -np.inf], np.nan)
    want = df[KEY].copy()

    def imb(a, b):
        return (df[a] - df[b]) / (df[a] + df[b])

    want["ob_imb0"], want["ob_imb4"], want["ob_imb9"] = imb("asize0", "bsize0"), imb("asize0_4", "bsize0_4"), imb("asize5_9", "bsize5_9")
    want["trade_imb"] = imb("tradeBuyQty", "tradeSellQty")
    want["trade_imbema5"] = want["trade_imb"].groupby(df["symbol"], group_keys=False).apply(lambda x: x.ewm(halflife=5).mean())
    past = df.groupby("symbol")["midpx"].shift(12)
    back = (df["midpx"] - past) / past
    want["lagret12"] = back - back.groupby(df["interval"]).transform("mean")
    want = want.replace([np.inf, -np.inf], np.nan).fillna(0)
    close(baseline_features(sbars).toPandas(), want, BASELINE_NAMES)
    close(baseline_features(sbars, max_rows=50).toPandas(), want, BASELINE_NAMES)


def test_zero_rows(sbars):
    assert features(sbars.where(F.lit(False))).count() == 0
