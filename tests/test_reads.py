"""How often the source is read, and one-pass moments against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.moments import moments
from barloom.operators.prepare import clean_bars, count_bars, fit_components, minmax, scaled_bars
from barloom.operators.profile import box_stats, describe
from barloom.operators.quantiles import quantiles
from barloom.plans.features import features
from barloom.sources.schema import BAR_COLUMNS, LABEL
from support import pandas_features, random_bars
from test_features import close

VALUES = [*BAR_COLUMNS, LABEL]


def counted(df):
    """The frame in one partition, and how often that was read."""
    reads = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        reads.add(1)
        yield from batches

    return df.coalesce(1).mapInArrow(run, df.schema), reads


@pytest.fixture(scope="module")
def heavy(spark):
    rng = np.random.default_rng(4)
    n = 200_000
    pdf = pd.DataFrame({"tied": rng.integers(0, 9, n).astype(float), "mostly": np.where(rng.random(n) < 0.7, 1.5, rng.normal(size=n)),
                        "plain": rng.normal(size=n), "whole": rng.integers(0, 10**9, n)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_describe_and_box_read_at_most_three_times(heavy):
    pdf, df = heavy
    frame, reads = counted(df)
    got = describe(frame).toPandas().set_index("column")
    want = pdf.describe().T
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        np.testing.assert_allclose(got.loc[want.index, ours], want[theirs], rtol=1e-9)
    assert reads.value == 2
    frame, reads = counted(df)
    box = box_stats(frame, list(pdf.columns)).toPandas().set_index("column")
    for c in pdf.columns:
        np.testing.assert_array_equal(box.loc[c, ["q1", "median", "q3"]].astype(float), np.quantile(pdf[c], [0.25, 0.5, 0.75]))
    assert reads.value == 3


def test_a_bracket_too_full_takes_one_more(heavy):
    pdf, df = heavy
    frame, reads = counted(df)
    got = quantiles(frame, list(pdf.columns), [0.1, 0.5, 0.99], small=300)
    for c in pdf.columns:
        np.testing.assert_array_equal(got[c], np.quantile(pdf[c], [0.1, 0.5, 0.99]))
    assert reads.value == 3


def test_brackets_that_miss_are_widened(heavy):
    pdf, df = heavy
    for margin in (0.0, 1e-6):  # far below the sketch's error
        got = quantiles(df, ["plain", "whole"], [0.3, 0.5], small=50, margin=margin)
        for c in got:
            np.testing.assert_array_equal(got[c], np.quantile(pdf[c], [0.3, 0.5]))


def test_scaling_and_components_read_little(spark):
    bars = spark.createDataFrame(random_bars(symbols=3, days=4, per_day=20))
    frame, reads = counted(bars)
    fast = scaled_bars(frame, VALUES)
    key = ["symbol", "date", "interval"]
    got = fast.toPandas().sort_values(key, ignore_index=True)
    assert reads.value == 2
    want = minmax(clean_bars(bars), VALUES).toPandas().sort_values(key, ignore_index=True)
    pd.testing.assert_frame_equal(got[[*key, *VALUES]], want[[*key, *VALUES]])
    frame, reads = counted(bars)
    scaled = scaled_bars(frame, VALUES)
    scores = fit_components(scaled, VALUES, shift=0.5).scores(scaled).toPandas()
    assert reads.value == 3 and len(scores) == len(want)
    centred = want[VALUES].to_numpy() - want[VALUES].to_numpy().mean(0)
    spread = np.sort(np.linalg.eigvalsh(np.cov(centred.T)))[::-1][:2]
    np.testing.assert_allclose(scores[["PC1", "PC2"]].var(), spread, rtol=1e-9)


def test_extremes_are_looked_for_again_where_rows_go(spark):
    pdf = random_bars(symbols=2, days=2, per_day=10, gaps=0, infs=0)
    bars = spark.createDataFrame(pdf).withColumn("note", F.when(F.col("midpx") < F.lit(float(pdf["midpx"].max())), "x"))
    assert not count_bars(bars).whole
    got, want = (f.select("midpx").toPandas()["midpx"] for f in (scaled_bars(bars, ["midpx"]), minmax(clean_bars(bars), ["midpx"])))
    assert sorted(got) == sorted(want) and max(got) == 1.0


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, size=(5000, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).repartition(6)
    found = moments(df, list("abcd"))
    np.testing.assert_allclose(found.covariance(), np.cov(x.T), rtol=1e-9)
    np.testing.assert_allclose(found.mean, x.mean(0), rtol=1e-14)
    np.testing.assert_array_equal([found.low, found.high], [x.min(0), x.max(0)])
    assert found.complete and found.rows == 5000


def test_moments_with_missing_values(spark):
    rows = [(1.0, 2.0, None), (2.0, None, None), (4.0, 1.0, None), (float("inf"), 5.0, None), (float("nan"), None, None)]
    found = moments(spark.createDataFrame(rows, "`a b` double, c double, d double"), ["a b", "c", "d"], [0.0, 3.0, 1.0])
    assert found.count.tolist() == [3, 3, 0] and found.rows == 5 and not found.complete
    np.testing.assert_allclose(found.mean[:2], [7 / 3, 8 / 3])
    both = sum((a - 7 / 3) * (c - 8 / 3) for a, c in ((1, 2), (4, 1)))
    np.testing.assert_allclose(found.centred[0, 1], both)
    np.testing.assert_allclose(found.centred[1, 0], both)
    assert moments(spark.createDataFrame([], "a double"), ["a"]).rows == 0


def test_universe_mean_reads(spark):
    pdf = random_bars(symbols=4, days=3, per_day=10)
    frame, reads = counted(spark.createDataFrame(pdf))
    got = features(frame, ["lagret12"], mean_scope="universe").toPandas()
    assert reads.value == 3
    close(got, pandas_features(pdf, "universe"), ["lagret12"])
