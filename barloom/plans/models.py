"""Forecasting models: boosted trees and a tree on MLlib, ridge on summed normal equations; storage, nodes, importances."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.operators.blocks import broadcast_up_to
from barloom.operators.moments import moments
from barloom.plans.boosting import LocalGBTRegressor
from barloom.session import checkpointed, drop_checkpoint, ensure_checkpoint_dir
from barloom.sources.schema import FORECAST, KEY, LABEL

VECTOR = "_features"

# Model settings.
BOOSTED = dict(maxDepth=6, maxIter=90, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9",
               minInstancesPerNode=3, maxBins=256, seed=1000, lossType="squared")
TREE = dict(maxDepth=10, maxBins=256, seed=42)
RIDGE_ALPHA = 0.5
FOLDS = 3


def repeatable(df: DataFrame) -> DataFrame:
    """Rows dealt by key to a fixed number of partitions and sorted there, so that samples drawn with a
    seed are the same whichever way the table was stored. One shuffle of the training columns."""
    keys = [c for c in KEY if c in df.columns]
    if not keys:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


@dataclass
class Forecaster:
    """An estimator over named feature columns. ``fit`` then ``predict``."""

    names: list[str]
    label: str = LABEL
    model: Model | None = field(default=None, init=False)
    stored_at: str | None = field(default=None, init=False)  # folder that holds the fitted model

    def estimator(self, train: DataFrame) -> Estimator:
        raise NotImplementedError

    def assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol=VECTOR).transform(df)

    @contextmanager
    def kept(self, data: DataFrame) -> Iterator[DataFrame]:
        """The training set is read once per pass of the solver, so it is kept for the fit."""
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield data
        finally:
            data.unpersist()

    def fit(self, train: DataFrame) -> "Forecaster":
        with self.kept(self.assemble(repeatable(train)).select(VECTOR, self.label)) as data:
            self.model, self.stored_at = self.estimator(data).fit(data), None
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Key, forecast and (where present) label: a map over the rows."""
        if self.model is None:
            raise ValueError("fit the model first")
        label = [self.label] if self.label in df.columns else []
        out = self.model.transform(self.assemble(df))
        return out.select(*[c for c in KEY if c in df.columns], FORECAST, *label)

    def save(self, path: str) -> "Forecaster":
        """Store the fitted model with the names of its columns; what was at ``path`` is replaced."""
        if self.model is None:
            raise ValueError("fit the model first")
        spark = SparkSession.active()
        self._write(spark, f"{path}/model")
        rows = [(-1, self.label), *enumerate(self.names)]
        spark.createDataFrame(rows, "place int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        self.stored_at = path
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forecaster":
        """The model stored at ``path``, ready to predict."""
        columns = {r["place"]: r["name"] for r in spark.read.parquet(f"{path}/columns").collect()}
        made = cls([columns[i] for i in range(len(columns) - 1)], columns[-1])
        made.model, made.stored_at = made._read(spark, f"{path}/model"), path
        return made

    def _write(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(path)

    def _read(self, spark: SparkSession, path: str) -> Model:
        return self.kind.load(path)

    def _columns(self) -> dict[str, str]:
        return dict(featuresCol=VECTOR, labelCol=self.label, predictionCol=FORECAST)


@dataclass
class BoostedTrees(Forecaster):
    settings: dict = field(default_factory=dict)
    kind = GBTRegressionModel

    @contextmanager
    def kept(self, data: DataFrame) -> Iterator[DataFrame]:
        """MLlib keeps the binned rows itself and runs a job for each level of each tree; every task of those
        carries the plan behind the training set, so that is cut off by a checkpoint, which goes after the fit."""
        data = checkpointed(data)
        try:
            yield data
        finally:
            drop_checkpoint(data)

    def estimator(self, train: DataFrame) -> Estimator:
        # MLlib cuts the lineage of its residuals every few rounds if it has a folder for it.
        ensure_checkpoint_dir(train.sparkSession)
        return LocalGBTRegressor(**self._columns(), **{**BOOSTED, **self.settings})


@dataclass
class Tree(Forecaster):
    settings: dict = field(default_factory=dict)
    kind = DecisionTreeRegressionModel

    def estimator(self, train: DataFrame) -> Estimator:
        return DecisionTreeRegressor(**self._columns(), **{**TREE, **self.settings})


@dataclass
class LinearModel:
    """A weight for each named column, no intercept."""

    names: list[str]
    coefficients: DenseVector

    def transform(self, df: DataFrame) -> DataFrame:
        terms = " + ".join(f"`{c}` * {float(w)!r}D" for c, w in zip(self.names, self.coefficients))
        return df.withColumn(FORECAST, F.expr(f"cast({terms or '0'} as double)"))


@dataclass
class Ridge(Forecaster):
    """Least squares with an L2 penalty ``alpha`` on the sum of squares, no intercept.

    The normal equations are summed up on the executors in one pass, and solved for as many unknowns
    as there are columns. Any label will do, a constant one too.
    """

    alpha: float = RIDGE_ALPHA

    def fit(self, train: DataFrame) -> "Ridge":
        found = moments(train, [*self.names, self.label], [0.0] * (len(self.names) + 1))
        if not found.rows:
            raise ValueError("the training set is empty")
        if not found.complete:
            raise ValueError("the training set has missing values")
        sums, p = found.raw(), len(self.names)
        solve = np.linalg.solve if self.alpha > 0 else lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]
        self.model, self.stored_at = LinearModel(list(self.names), DenseVector(solve(sums[:p, :p] + self.alpha * np.eye(p), sums[:p, p]))), None
        return self

    def assemble(self, df: DataFrame) -> DataFrame:
        return df

    def _write(self, spark: SparkSession, path: str) -> None:
        rows = [(c, float(w)) for c, w in zip(self.names, self.model.coefficients)]
        spark.createDataFrame(rows, "name string, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    def _read(self, spark: SparkSession, path: str) -> LinearModel:
        weight = {r["name"]: r["weight"] for r in spark.read.parquet(path).collect()}
        return LinearModel(list(self.names), DenseVector([weight[c] for c in self.names]))


def node_table(forecaster: Forecaster, spark: SparkSession) -> DataFrame:
    """(tree, node, feature, threshold, gain, rows, prediction): every node of a fitted tree model; leaves have no feature.

    Read as data from the stored model. A model that was neither saved nor loaded is stored for that first.
    """
    if forecaster.stored_at is None:
        ensure_checkpoint_dir(spark)
        forecaster.save(f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}")
    nodes = spark.read.parquet(f"{forecaster.stored_at}/model/data")
    if "treeID" not in nodes.columns:
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    names = spark.read.parquet(f"{forecaster.stored_at}/columns").where("place >= 0")
    split = F.col("nodeData.leftChild") >= 0
    flat = nodes.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.when(split, F.col("nodeData.split.featureIndex")).alias("place"),
        F.when(split, F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(split, F.col("nodeData.gain")).alias("gain"), F.col("nodeData.rawCount").alias("rows"), F.col("nodeData.prediction").alias("prediction"))
    return flat.join(F.broadcast(names), "place", "left").select("tree", "node", F.col("name").alias("feature"), "threshold", "gain", "rows", "prediction")


def split_importance(forecaster: Forecaster, spark: SparkSession) -> DataFrame:
    """(feature, splits, fscore) of a fitted tree model, ascending; unused features are left out.

    ``fscore`` is the share of all splits.
    """
    splits = node_table(forecaster, spark).where("feature is not null").groupBy("feature").agg(F.count("*").alias("splits"))
    share = F.col("splits") / F.sum("splits").over(Window.partitionBy(F.lit(0)))  # a row per feature
    return splits.withColumn("fscore", share).orderBy("fscore", "feature")


def date_folds(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Add ``fold``: consecutive groups of dates of equal number."""
    days = df.select("date").distinct()
    # One row per date: a small ordered window.
    order = Window.orderBy("date")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(order) - 1) * folds
    days = days.select("date", F.floor(place / F.count("*").over(whole)).cast("int").alias("fold"))
    return df.join(broadcast_up_to(days, days.count()), "date")
