"""Backward elimination of features as a job that a restart goes on with.

The job's folder holds the training table, prepared once, and a log with a row for each finished
step. A run reads the log and goes on behind its last step; as each step depends on the stored table
and the steps before it only, an interrupted job ends with the same log as one that was not.

Features are stored as their bins (at most ``BINS`` quantile ranges, numbered from 0), so
trees of every fold and step choose among the same cuts and nothing is sketched again. Folds are ranges of dates.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import QuantileDiscretizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.plans.models import BOOSTED, FOLDS, VECTOR, date_folds, repeatable
from barloom.session import ensure_checkpoint_dir, folder_exists
from barloom.sources.schema import FORECAST, KEY, LABEL

BINS = 256
STEP_DDL = "n_features int, mse double, dropped string, features string"


@dataclass
class EliminationJob:
    """``names`` are dropped one at a time, by the importance in a fit on all rows, until ``smallest`` are left.

    The set with the lowest mean squared error over the folds wins, the smaller of equal ones.
    A step fits folds + 1 models. ``settings`` overrides the boosted-tree settings.
    """

    root: str
    names: list[str]
    label: str = LABEL
    folds: int = FOLDS
    smallest: int = 1
    settings: dict | None = None

    def prepare(self, df: DataFrame) -> "EliminationJob":
        """Store the binned training table, once; a folder of another job is an error."""
        spark = df.sparkSession
        plan = json.dumps([self.names, self.label, self.folds, self.smallest, self.settings or {}], sort_keys=True)
        if folder_exists(spark, f"{self.root}/plan/_SUCCESS"):
            if spark.read.text(f"{self.root}/plan").first()[0] != plan:
                raise ValueError(f"{self.root} holds another job")
            return self
        keys = [c for c in KEY if c in df.columns]
        table = date_folds(df.select(*keys, *self.names, self.label), self.folds)
        bins = [f"_b{i}" for i in range(len(self.names))]
        cut = QuantileDiscretizer(numBuckets=BINS, inputCols=self.names, outputCols=bins, relativeError=1e-4).fit(table)
        binned = cut.transform(table).select(*keys, "fold", self.label, *[F.col(b).cast("short").alias(b) for b in bins])
        repeatable(binned).write.mode("overwrite").parquet(f"{self.root}/table")
        spark.createDataFrame([(plan,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/plan")  # last: the job is complete
        return self

    def log(self, spark: SparkSession) -> DataFrame:
        """n_features, mse, dropped (NULL in the last step), features: a row for each finished step."""
        if not folder_exists(spark, f"{self.root}/steps"):
            return spark.createDataFrame([], STEP_DDL)
        return spark.read.schema(STEP_DDL).option("recursiveFileLookup", True).parquet(f"{self.root}/steps")

    def left(self, spark: SparkSession) -> list[str]:
        """The features of the next step; none if the job is done."""
        last = self.log(spark).orderBy("n_features").first()
        if last is None:
            return list(self.names)
        return [] if last["dropped"] is None else [c for c in last["features"].split(",") if c != last["dropped"]]

    def step(self, spark: SparkSession) -> bool:
        """Run and log the next step; False if there is none."""
        current = self.left(spark)
        if not current:
            return False
        place = {c: i for i, c in enumerate(self.names)}
        table = spark.read.parquet(f"{self.root}/table").withColumn("fold", F.col("fold").cast("int"))
        inputs = [f"_b{place[c]}" for c in current]
        vectors = VectorAssembler(inputCols=inputs, outputCol=VECTOR).transform(table).select("fold", VECTOR, self.label)
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        ensure_checkpoint_dir(spark)
        try:
            search = CrossValidator(
                estimator=GBTRegressor(featuresCol=VECTOR, labelCol=self.label, predictionCol=FORECAST, **{**BOOSTED, **(self.settings or {})}),
                estimatorParamMaps=ParamGridBuilder().build(),
                evaluator=RegressionEvaluator(labelCol=self.label, predictionCol=FORECAST, metricName="mse"),
                numFolds=self.folds, foldCol="fold", parallelism=self.folds,
            ).fit(vectors)
        finally:
            vectors.unpersist()
        weights = search.bestModel.featureImportances.toArray()
        worst = min(range(len(current)), key=lambda i: (weights[i], i))
        more = len(current) > max(self.smallest, 1)
        row = [(len(current), float(search.avgMetrics[0]), current[worst] if more else None, ",".join(current))]
        # One file; it appears when its job commits.
        spark.createDataFrame(row, STEP_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/steps/{len(current):04d}")
        return True

    def run(self, spark: SparkSession) -> "EliminationJob":
        while self.step(spark):
            pass
        return self

    def selected(self, spark: SparkSession) -> list[str]:
        best = self.log(spark).orderBy("mse", "n_features").first()
        if best is None:
            raise ValueError("no step is finished")
        return best["features"].split(",")

    def reduced(self, df: DataFrame) -> DataFrame:
        """``df`` with its key, the selected features and the label only."""
        keep = [*[c for c in KEY if c in df.columns], *self.selected(df.sparkSession), *([self.label] if self.label in df.columns else [])]
        return df.select(*keep)


def eliminate(df: DataFrame, names: list[str], root: str, **options) -> EliminationJob:
    """The whole job; run again on the same folder, it goes on where it was."""
    return EliminationJob(root, list(names), **options).prepare(df).run(df.sparkSession)
