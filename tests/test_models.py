import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from barloom.operators.calendar import TradingCalendar
from barloom.plans import boosting
from barloom.plans.boosting import LocalGBTRegressor
from barloom.plans.engine import Engine
from barloom.plans.features import BASELINE_NAMES, baseline_features, features
from barloom.plans.metrics import metrics, summary_line
from barloom.plans.models import BOOSTED, BoostedTrees, Ridge, Tree, date_folds, node_table, split_importance
from barloom.session import ensure_checkpoint_dir
from support import random_bars

FAST = dict(maxDepth=3, maxIter=4)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 1200
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "noise"])
    pdf["fret12"] = 2 * pdf["a"] - pdf["b"] + rng.normal(0, 0.1, n)
    pdf["symbol"], pdf["date"], pdf["interval"] = 1, 20240101 + np.arange(n) // 100, np.arange(n) % 100
    return pdf, spark.createDataFrame(pdf).cache()


def reference_metrics(f, y):
    f, y = (np.where(np.isfinite(v), v, 0) for v in (f, y))
    sse = ((f - y) ** 2).sum()
    return np.corrcoef(f, y)[0, 1], 1 - sse / np.var(y, ddof=1) / len(y), sse / len(y), len(y)


def test_metrics(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=500)
    f = y + rng.normal(size=500)
    f[::17], y[::23], f[::31] = np.nan, np.nan, np.inf
    row = metrics(spark.createDataFrame(pd.DataFrame({"forecast": f, "fret12": y}))).first()
    np.testing.assert_allclose(list(row), reference_metrics(f, y), rtol=1e-12)
    assert summary_line(row).startswith("Pearson correlation=0.")


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "forecast double, fret12 double")
    row = metrics(df).first()
    assert row["pcor"] is None and row["mse"] == 2.5
    row = metrics(df.limit(1)).first()
    assert (row["pcor"], row["r2"], row["mse"], row["n"]) == (None, None, 1.0, 1)
    assert metrics(df.limit(0)).first()["n"] == 0


def test_ridge_closed_form(table):
    pdf, df = table
    names = ["a", "b", "noise"]
    model = Ridge(names, alpha=0.5).fit(df)
    x, y = pdf[names].to_numpy(), pdf["fret12"].to_numpy()
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.T @ y)
    np.testing.assert_allclose(model.model.coefficients.toArray(), want, rtol=1e-10)
    assert model.predict(df).columns == ["symbol", "date", "interval", "forecast", "fret12"]
    flat = Ridge(names).fit(df.withColumn("fret12", df["a"] * 0 + 1))
    np.testing.assert_allclose(flat.model.coefficients.toArray(), np.linalg.solve(x.T @ x + 0.5 * np.eye(3), x.sum(0)), rtol=1e-9)
    with pytest.raises(ValueError, match="empty"):
        Ridge(names).fit(df.limit(0))
    with pytest.raises(ValueError, match="missing"):
        Ridge(names).fit(df.withColumn("a", F.when(df["a"] > 0, df["a"])))
    with pytest.raises(ValueError, match="fit the model"):
        Ridge(names).predict(df)


@pytest.mark.parametrize("make", [lambda n: BoostedTrees(n, settings=dict(maxDepth=4, maxIter=12, stepSize=0.3)), lambda n: Tree(n)])
def test_trees_learn_and_repeat(table, make):
    _, df = table
    names = ["a", "b", "noise"]
    first, second = (make(names).fit(df).predict(df).orderBy("date", "interval").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(first, second)
    assert metrics(make(names).fit(df).predict(df)).first()["pcor"] > 0.9


def test_training_does_not_depend_on_the_partitioning(table):
    _, df = table
    names, settings = ["a", "b", "noise"], dict(FAST, subsamplingRate=0.6)
    trees = [BoostedTrees(names, settings=settings).fit(d).model.toDebugString.split("\n", 1)[1] for d in (df.repartition(7, "a"), df.coalesce(1))]
    assert trees[0] == trees[1]


def test_boosting_starts_from_a_stored_training_set(spark, table, monkeypatch):
    """The tasks of each level carry all that the training set is made from, unless it is cut off."""
    _, df = table
    names, seen, fit = ["a", "b", "noise"], [], GBTRegressor.fit
    ensure_checkpoint_dir(spark)
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    stored = lambda: {p.parent for p in root.glob("rdd-*/part-*")}
    before = stored()

    def watched(self, data):
        seen.append((data._jdf.queryExecution().toRdd().toDebugString(), len(stored() - before)))
        return fit(self, data)

    monkeypatch.setattr(GBTRegressor, "fit", watched)
    BoostedTrees(names, settings=FAST).fit(df)
    (lineage, made), = seen
    assert "ReliableCheckpointRDD" in lineage and "Shuffled" not in lineage and made == 1
    assert stored() == before


def ties_and_gaps(spark, n, partitions):
    """Columns that split alike, few values, zeros, one value only; labels in steps."""
    rng = np.random.default_rng(n)
    a = rng.normal(size=n)
    few, zeros = rng.integers(0, 4, n).astype(float), np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n))
    x = np.column_stack([a, a, np.exp(a), -a, few, zeros, np.zeros(n), rng.normal(size=n)])
    y = np.where(rng.random(n) < 0.3, 0.0, np.round(a + few * zeros, 1))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdefgh")).assign(fret12=y)).repartition(partitions, "a")
    return VectorAssembler(inputCols=list("abcdefgh"), outputCol="_features").transform(df).cache()


def all_nodes(model):
    """Every node with all its numbers."""
    def below(node):
        own = [node.prediction(), node.impurity(), list(node.impurityStats().stats()), node.impurityStats().rawCount()]
        if node.getClass().getSimpleName() == "LeafNode":
            return own
        return own + [node.gain(), node.split().featureIndex(), node.split().threshold(), below(node.leftChild()), below(node.rightChild())]

    return [below(t._java_obj.rootNode()) for t in model.trees], model.treeWeights


@pytest.mark.parametrize("n, partitions, settings", [
    (3000, 3, dict(maxDepth=6)),  # many ties, leaves joined
    (12_000, 5, dict(maxBins=16, minInstancesPerNode=40)),  # candidates from a sample, drawn row by row
    (30_000, 2, dict(maxBins=16, minInfoGain=0.01)),  # a small sample, drawn by gaps
    (2000, 7, dict(featureSubsetStrategy="0.3", subsamplingRate=0.2, maxDepth=8)),
    (900, 1, dict(featureSubsetStrategy="all", subsamplingRate=1.0)),
    (3, 2, dict()),
])
def test_one_task_boosts_the_trees_of_mllib(spark, n, partitions, settings):
    df = ties_and_gaps(spark, n, partitions)
    options = dict(featuresCol="_features", labelCol="fret12") | {**BOOSTED, "maxIter": 6, "maxDepth": 4, **settings}
    assert all_nodes(LocalGBTRegressor(**options).fit(df)) == all_nodes(GBTRegressor(**options).fit(df))


def jobs_of(spark, fit):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "fit")
    try:
        return fit(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def test_small_sets_take_few_jobs(spark, table, monkeypatch):
    """A job for each level of each tree costs minutes; a set that a task holds goes without."""
    _, df = table
    settings = dict(maxDepth=4, maxIter=12)
    make = lambda: BoostedTrees(["a", "b", "noise"], settings=settings).fit(df).model
    small, few = jobs_of(spark, make)
    monkeypatch.setattr(boosting, "CELLS", 1200 * 3 - 1)
    large, many = jobs_of(spark, make)
    assert few <= 12 and many >= 48 and all_nodes(small) == all_nodes(large)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_values_that_mllib_refuses_stay_errors(spark, table, bad):
    _, df = table
    with pytest.raises(Exception, match="(?i)nan|infinity|null"):
        BoostedTrees(["a", "b"], settings=FAST).fit(df.withColumn("fret12", F.when(F.col("a") > 0, F.col("fret12")).otherwise(F.lit(bad).cast("double"))))


def test_split_importance(spark, table):
    _, df = table
    model = BoostedTrees(["a", "b", "noise"], settings=FAST).fit(df)
    got = split_importance(model, spark).toPandas()
    assert got["fscore"].sum() == pytest.approx(1) and got["fscore"].is_monotonic_increasing
    assert set(got["feature"]) <= {"a", "b", "noise"}
    internal = sum((t.numNodes - 1) // 2 for t in model.model.trees)
    assert got["splits"].sum() == internal


def test_folds_are_date_ranges(table):
    _, df = table
    per = date_folds(df).groupBy("fold").agg({"date": "min", "*": "count"}).orderBy("fold").collect()
    assert [(r["fold"], r["min(date)"], r["count(1)"]) for r in per] == [(0, 20240101, 400), (1, 20240105, 400), (2, 20240109, 400)]


@pytest.mark.parametrize("model", [BoostedTrees(["a", "b", "noise"], settings=FAST), Tree(["a", "b", "noise"]), Ridge(["a", "b", "noise"])])
def test_stored_models_forecast_the_same(spark, table, model, tmp_path):
    _, df = table
    before = model.fit(df).predict(df).orderBy("date", "interval").toPandas()
    model.save(str(tmp_path / "m"))
    loaded = type(model).load(spark, str(tmp_path / "m"))
    assert loaded.names == ["a", "b", "noise"] and loaded.label == "fret12"
    pd.testing.assert_frame_equal(loaded.predict(df).orderBy("date", "interval").toPandas(), before)
    if not isinstance(model, Ridge):
        a, b = (split_importance(m, spark).toPandas() for m in (model, loaded))
        pd.testing.assert_frame_equal(a, b)


def test_nodes(spark, table):
    _, df = table
    model = Tree(["a", "b", "noise"], settings=dict(maxDepth=2)).fit(df)
    nodes = node_table(model, spark).toPandas()
    assert len(nodes) == model.model.numNodes == 7 and nodes["feature"].notna().sum() == 3
    root = nodes[nodes["node"] == 0].iloc[0]
    assert root["feature"] == "a" and f"{root['threshold']}" in model.model.toDebugString and root["rows"] == 1200


@pytest.fixture(scope="module")
def engine_inputs(spark):
    bars = spark.createDataFrame(random_bars(symbols=3, days=8, per_day=20, gaps=0, infs=0)).cache()
    return bars, TradingCalendar.from_column(bars, "date")


def test_engine(engine_inputs):
    bars, cal = engine_inputs
    engine = Engine(bars, cal, model=Ridge(list(BASELINE_NAMES)), plan=baseline_features)
    row = engine.fit(20240102, 20240106).eval(20240107, 20240109).first()
    assert row["n"] == 3 * 3 * 20 and row["mse"] >= 0
    with pytest.raises(ValueError):
        engine.fit(20240106, 20240102)


def test_open_can_refuse_duplicate_keys(spark, engine_inputs, tmp_path):
    bars, cal = engine_inputs
    bars.unionByName(bars.limit(1)).write.partitionBy("date").parquet(str(tmp_path / "bars"))
    Engine.open(spark, str(tmp_path / "bars"), cal)
    with pytest.raises(ValueError, match="duplicate key"):
        Engine.open(spark, str(tmp_path / "bars"), cal, check_keys=True)


def test_warmup(engine_inputs):
    bars, cal = engine_inputs
    cold = Engine(bars, cal).features(20240107, 20240109)
    warm = Engine(bars, cal, warmup_days=2).features(20240107, 20240109)
    assert cold.count() == warm.count()
    whole = features(bars).where("date >= 20240107")
    pick = ["symbol", "date", "interval", "momentum_midpx", "rolling_std_midpx_5"]
    assert warm.select(pick).exceptAll(whole.select(pick)).count() == 0
    assert cold.select(pick).exceptAll(whole.select(pick)).count() > 0
