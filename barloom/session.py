"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "barloom") -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prefer_compiled_projections(spark: SparkSession) -> None:
    """Let wide projections leave whole-stage code generation.

    HotSpot does not compile methods of more than 8000 bytes of bytecode. A stage
    whose generated method is larger runs interpreted, several times slower than
    the same projection outside whole-stage code generation, where Spark splits
    it into small methods. A limit the user has lowered already is kept.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > 8000:
        spark.conf.set(name, "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame that ``checkpointed`` gave; it can't be read any more."""
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
