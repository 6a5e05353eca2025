import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.blocks import series
from barloom.operators.windows import (
    Trailing, bfill, ewm, ffill, fill_both, halflife_decay, index_rows, lags, span_decay,
)

KEY = ["symbol", "date", "interval"]


def long_series(n=6000, symbols=2, seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for s in range(symbols):
        x = 100 + np.cumsum(rng.normal(size=n))
        x[rng.random(n) < 0.1] = np.nan
        x[1500:4200] = np.nan
        x[5000:5900] = np.nan
        if s == 1:
            x[:700] = np.nan
        frames.append(pd.DataFrame({"symbol": s, "date": 20240101 + np.arange(n) // 240, "interval": np.arange(n) % 240, "x": x}))
    return pd.concat(frames, ignore_index=True)


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=0)).withColumn("x", F.expr("if(isnan(x), null, x)"))


def run_ewm(spark, pdf, max_rows):
    specs = {"a": ("x", halflife_decay(5)), "b": ("x", span_decay(30))}
    s = index_rows(series(spark_frame(spark, pdf), before=12, max_rows=max_rows))
    return ewm(s, specs).own().toPandas().sort_values(KEY)


@pytest.mark.parametrize("max_rows", [10**6, 1000, 50])
def test_ewm_long_runs(spark, max_rows):
    pdf = long_series()
    got = run_ewm(spark, pdf, max_rows)
    assert len(got) == len(pdf)
    for out, kw in (("a", dict(halflife=5)), ("b", dict(span=30))):
        want = pdf.groupby("symbol", group_keys=False)["x"].apply(lambda x: x.ewm(**kw).mean()).to_numpy()
        np.testing.assert_array_equal(np.isnan(got[out].to_numpy()), np.isnan(want))
        np.testing.assert_allclose(got[out].to_numpy(), want, rtol=1e-10)


def test_ewm_hand_case(spark):
    pdf = pd.DataFrame({"symbol": 1, "date": 1, "interval": range(5), "x": [1, np.nan, 3, np.nan, 5]})
    got = run_ewm(spark, pdf, 10**6)["a"].tolist()
    np.testing.assert_allclose(got, [1, 1, 2.137748144461568, 2.137748144461568, 3.3650196902842615], rtol=1e-14)


@pytest.mark.parametrize("values, skew, kurt, std", [
    ([2, 2, 2, 2, 2], 0, -3, 0), ([2, 2, 2, 2, 3], 2.2360679775, 5, 0.4472135955),
    ([0.1] * 5, 0, -3, 0), ([1, 1, 1, 1, 1 + 1e-8], None, None, 4.4721359e-9), ([1, None, 1, 2, 3], None, None, None),
])
def test_trailing_hand_cases(spark, values, skew, kurt, std):
    df = spark.createDataFrame([(1, 1, i, None if v is None else float(v)) for i, v in enumerate(values)],
                               "symbol long, date int, interval long, x double")
    s = lags(series(df), {"x": [1, 2, 3, 4]})
    t = Trailing("x", 5, 4)
    row = s.df.select("*", *t.sums()).where("interval = 4").selectExpr(
        f"{t.skew()} as skew", f"{t.kurt()} as kurt", f"{t.std()} as std", f"{t.max()} as hi", f"{t.min()} as lo", f"{t.mean()} as mean").first()
    for got, want in ((row["skew"], skew), (row["kurt"], kurt), (row["std"], std)):
        assert got is None if want is None else got == pytest.approx(want, rel=1e-7, abs=1e-15)
    if None not in values:
        assert (row["hi"], row["lo"]) == (max(values), min(values)) and row["mean"] == pytest.approx(np.mean(values))
    else:
        assert row["hi"] is row["lo"] is row["mean"] is None
    # pandas agrees on what is reported and what is not
    p = pd.Series(values, dtype=float).rolling(5)
    assert (row["skew"] is None) == bool(np.isnan(p.skew().iloc[-1])) and (row["kurt"] is None) == bool(np.isnan(p.kurt().iloc[-1]))


@pytest.mark.parametrize("max_rows", [10**6, 500])
def test_fills(spark, max_rows):
    pdf = long_series(n=3000)
    df = spark_frame(spark, pdf)
    g = pdf.groupby("symbol")["x"]
    for op, want in ((ffill, g.ffill()), (bfill, g.bfill()), (fill_both, g.ffill().groupby(pdf["symbol"]).bfill())):
        got = op(series(df, max_rows=max_rows), ["x"]).own().toPandas().sort_values(KEY)["x"].to_numpy()
        np.testing.assert_array_equal(got, want.to_numpy())


def test_blocks_cover_each_row_once(spark):
    pdf = long_series(n=3000)
    s = series(spark_frame(spark, pdf), before=12, after=12, max_rows=400)
    assert s.blocked
    per = s.df.where("_own").groupBy("symbol", "_blk").count().toPandas()
    assert per["count"].sum() == len(pdf) and per["count"].max() <= 800 and len(per) >= 12
    # copies are a small share
    assert s.df.count() < 1.9 * len(pdf)


def test_uneven_intervals_are_cut_evenly(spark):
    """One far interval, and two dense stretches of a day: no block gets most of the day."""
    at = np.concatenate([np.arange(2500), 10**9 + np.arange(2500), [10**12]])
    pdf = pd.DataFrame({"symbol": 1, "date": 20240101, "interval": at, "x": np.arange(len(at), dtype=float)})
    s = series(spark_frame(spark, pdf), before=12, max_rows=400)
    per = s.df.where("_own").groupBy("_blk").count().toPandas()
    assert per["count"].sum() == len(pdf) and per["count"].max() <= 800 and len(per) >= 10
    got = run_ewm(spark, pdf, 400)
    np.testing.assert_allclose(got["a"].to_numpy(float), pdf["x"].ewm(halflife=5).mean().to_numpy(), rtol=1e-10)


def test_lead_over_blocks(spark):
    pdf = long_series(n=2000)
    from barloom.sources.events import forward_return

    df = spark_frame(spark, pdf).withColumnRenamed("x", "midpx")
    got = forward_return(df, max_rows=300).toPandas().sort_values(KEY)["fret12"].to_numpy()
    want = (pdf.groupby("symbol")["x"].shift(-12) / pdf["x"] - 1).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("gap", [1023, 1024, 1025, 2974])
@pytest.mark.parametrize("max_rows", [None, 500, 4000])
def test_ewm_gap_over_stretches(spark, gap, max_rows):
    """A gap repeats the last present value, wherever in a stretch it begins."""
    frames = []
    for s, start in enumerate([0, 1, 7, 1020, 1023, 1024, 1026]):
        x = 100 + np.random.default_rng(s).normal(size=6000)
        x[start : start + gap] = np.nan
        frames.append(pd.DataFrame({"symbol": s, "date": 20240101 + np.arange(6000) // 240, "interval": np.arange(6000) % 240, "x": x}))
    pdf = pd.concat(frames, ignore_index=True)
    got = run_ewm(spark, pdf, max_rows)
    for name, kw in (("a", {"halflife": 5}), ("b", {"span": 30})):
        want = pdf.groupby("symbol", group_keys=False)["x"].apply(lambda x: x.ewm(**kw).mean()).to_numpy()
        np.testing.assert_allclose(got[name].to_numpy(float), want, rtol=1e-10)


def test_carry_holds_only_cut_symbols(spark):
    """One big symbol and many small ones: what is handed on stays within the number of blocks."""
    rows = spark.range(400).selectExpr("0L symbol", "20240101 date", "id interval", "double(id) x").unionByName(
        spark.range(3000).selectExpr("id + 1 symbol", "20240101 date", "0L interval", "double(id) x"))
    s = index_rows(series(rows, before=2, max_rows=100))
    assert s.cut().select("symbol", "_blk").distinct().count() <= s.blocks
    assert s.cut().select("symbol").distinct().count() == 1
    assert ffill(s, ["x"]).own().count() == 3400
