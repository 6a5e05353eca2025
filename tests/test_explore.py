import numpy as np
import pandas as pd
import pytest

from barloom.operators.prepare import (
    clean_bars, drop_lunch, fill_mean, fit_components, minmax, price_series, volume_series,
)
from barloom.operators.profile import box_stats, describe, histogram, info, missing_check
from barloom.operators.quantiles import quantiles
from support import random_bars

KEY = ["symbol", "date", "interval"]


@pytest.fixture(scope="module")
def pdf():
    return random_bars(symbols=2, days=6, per_day=20, seed=5)


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def indexed(df):
    return df.toPandas().set_index("column")


def test_info(bars, pdf):
    got = indexed(info(bars))
    assert got["dtype"].to_dict() == dict(bars.dtypes)
    assert got["non_null"].to_dict() == pdf.notna().sum().to_dict()


@pytest.mark.parametrize("approx", [False, True])
def test_describe(bars, pdf, approx):
    got = indexed(describe(bars, approx=approx))
    want = pdf.replace([np.inf, -np.inf], np.nan).describe().T
    assert set(got.index) == set(pdf.columns)
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max")):  # symbols are large: std loses digits
        np.testing.assert_allclose(got.loc[want.index, ours], want[theirs], rtol=1e-7)
    if not approx:
        for ours, theirs in (("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
            np.testing.assert_allclose(got.loc[want.index, ours], want[theirs], rtol=1e-12)


@pytest.mark.parametrize("small", [1, 10, 500])
def test_quantiles_by_refinement(spark, small):
    rng = np.random.default_rng(0)
    heavy = rng.normal(size=20000).round(1)
    heavy[:9000] = 0.3
    cols = {"u": rng.random(20000), "heavy": heavy, "wide": np.exp(rng.normal(0, 20, 20000)), "one": np.full(20000, 7.0)}
    df = spark.createDataFrame(pd.DataFrame(cols)).repartition(7)
    probs = [0, 0.01, 0.25, 0.5, 0.75, 0.999, 1]
    got = quantiles(df, list(cols), probs, small=small)
    for c, v in cols.items():
        np.testing.assert_allclose(got[c], np.quantile(v, probs), rtol=1e-12)


def test_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_histogram(bars, pdf):
    cols = ["midpx", "tradeBuyQty", "ask0"]
    got = histogram(bars, cols).toPandas()
    for c in cols:
        v = pdf[c].to_numpy()
        n, edges = np.histogram(v[np.isfinite(v)], bins=20)
        mine = got[got["column"] == c].sort_values("bin")
        np.testing.assert_array_equal(mine["n"], n)
        np.testing.assert_allclose(mine["left"], edges[:-1], rtol=1e-12)
        np.testing.assert_allclose(mine["right"], edges[1:], rtol=1e-12)


def test_histogram_of_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    got = histogram(df).toPandas().sort_values("bin")
    n, edges = np.histogram([3.0] * 4, bins=20)
    np.testing.assert_array_equal(got["n"], n)
    assert got["left"].iloc[0] == 2.5 and got["right"].iloc[-1] == 3.5


def test_box(bars, pdf):
    got = indexed(box_stats(bars, ["midpx", "high", "tradeBuyQty"]))
    for c, r in got.iterrows():
        v = pdf[c].to_numpy()
        v = v[np.isfinite(v)]
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        np.testing.assert_allclose(
            r[["q1", "median", "q3", "whisker_low", "whisker_high", "outliers_low", "outliers_high"]].astype(float),
            [q1, med, q3, v[v >= lo].min(), v[v <= hi].max(), (v < lo).sum(), (v > hi).sum()], rtol=1e-12)


def test_missing_check(spark):
    df = spark.createDataFrame([(1.0, None, float("inf")), (float("nan"), 2.0, 1.0)], "a double, b double, c double")
    got = indexed(missing_check(df))
    assert got["has_null"].to_dict() == {"a": True, "b": True, "c": False}
    assert got["has_inf"].to_dict() == {"a": False, "b": False, "c": True}


def test_lunch_keeps_null_interval(spark):
    df = spark.createDataFrame([(i,) for i in (112959, 113000, 120000, 130000, 130001, 20230601120000, 20230601093000, None)], "interval long")
    assert {r[0] for r in drop_lunch(df).collect()} == {112959, 130001, 20230601093000, None}


def pandas_clean(pdf):
    df = pdf.sort_values(KEY).replace([np.inf, -np.inf], np.nan)
    df = df[~df["interval"].mod(1000000).between(113000, 130000)].reset_index(drop=True)
    values = [c for c in df.columns if c not in KEY]
    df[values] = df.groupby("symbol")[values].ffill()
    df[values] = df.groupby("symbol")[values].bfill()
    return df.dropna()


@pytest.mark.parametrize("max_rows", [10**6, 30])
def test_clean(bars, pdf, max_rows):
    got = clean_bars(bars, max_rows=max_rows).toPandas().sort_values(KEY).reset_index(drop=True)
    want = pandas_clean(pdf)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_clean_without_fill(bars, pdf):
    want = pdf[~pdf["interval"].mod(1000000).between(113000, 130000)].dropna()
    assert clean_bars(bars, fill=False).count() == len(want)


def test_clean_empty_columns(spark):
    rows = [(1, 1, 1, None, 2.0), (1, 1, 2, None, 3.0), (2, 1, 1, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "symbol long, date int, interval long, a double, b double")
    assert {r["a"] for r in clean_bars(df).collect()} == {4.0}
    with pytest.raises(ValueError, match="a"):
        clean_bars(df.where("symbol = 1"))
    with pytest.raises(ValueError, match="a"):
        fill_mean(df.where("symbol = 1"), ["a", "b"])


def test_minmax(bars, pdf):
    clean = pandas_clean(pdf).assign(flat=5.0)
    got = minmax(clean_bars(bars).selectExpr("*", "5D as flat")).toPandas().sort_values(KEY)
    for c in ("midpx", "date", "flat", "tradeBuyQty"):
        v = clean[c].to_numpy(float)
        want = (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else np.zeros(len(v))
        np.testing.assert_allclose(got[c].to_numpy(float) if c != "date" else np.sort(got[c].to_numpy(float)),
                                   want if c != "date" else np.sort(want), atol=1e-12)


def test_components(bars, pdf):
    scaled = minmax(clean_bars(bars), ["midpx", "high", "low", "tradeBuyQty", "asize0"])
    names = ["midpx", "high", "low", "tradeBuyQty", "asize0"]
    fitted = fit_components(scaled, names)
    x = scaled.orderBy(*KEY).toPandas()[names].to_numpy()
    x = x - x.mean(axis=0)
    _, sv, vt = np.linalg.svd(x, full_matrices=False)
    for j in range(2):
        if vt[j][np.abs(vt[j]).argmax()] < 0:
            vt[j] = -vt[j]
    loadings = fitted.loadings(scaled).toPandas().set_index("feature").loc[names]
    np.testing.assert_allclose(loadings.to_numpy(), vt[:2].T, atol=1e-9)
    np.testing.assert_allclose(fitted.explained, (sv**2 / (sv**2).sum())[:2], rtol=1e-9)
    scores = fitted.scores(scaled).orderBy(*KEY).toPandas()
    np.testing.assert_allclose(scores[["PC1", "PC2"]].to_numpy(), x @ vt[:2].T, atol=1e-9)
    ordered = [r[1] for r in fitted.sorted_loadings(scaled, 2).collect()]
    assert ordered == sorted(ordered, reverse=True)


def test_series_views(bars):
    assert price_series(bars).columns == [*KEY, "midpx", "open", "high", "low", "lastpx"]
    rows = [tuple(r) for r in volume_series(bars).select(*KEY).collect()]
    assert rows == sorted(rows)


def test_minmax_of_wide_infinite_and_oddly_named_columns(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, -1.7e308, 3.0), (inf, 1.7e308, 3.0), (2.0, 0.0, None)], "`a b` double, wide double, same double")
    got = minmax(df, df.columns).collect()
    assert [r["a b"] for r in got] == [0.0, None, 1.0]
    assert [r["wide"] for r in got] == [0.0, 1.0, 0.5]
    assert [r["same"] for r in got] == [0.0, 0.0, None]
