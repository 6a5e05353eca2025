"""What the operators share: document columns, stored intermediate tables, Arrow output."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from barloom.session import ensure_checkpoint_dir

# Sort key of a row without an id: before every other.
NO_ID = -(1 << 63)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(NO_ID))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``_text`` only, so that no other column of the input can clash. A null text is empty."""
    return docs.select(id_key(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(_id, _h, _text) without equal rows. ``_h`` tells rows of one id apart and is 0 if ids are unique.

    With ``keep`` the other columns come along as the struct ``_keep``.
    """
    rows = texts(docs, id_col, text_col)
    if keep:
        rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
        rows = docs.select(id_key(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct(*rest, F.lit(0).alias("_none")).alias("_keep"))
    if not rows.groupBy("_id").count().where("count > 1").limit(1).count():
        return rows.withColumn("_h", F.lit(0).cast("bigint"))
    return rows.withColumn("_h", F.xxhash64("_text")).dropDuplicates(["_id", "_h"])


def rebuilt(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``documents(keep=True)`` with the columns of ``docs`` again; n_chars follows the text."""
    kinds = dict(docs.dtypes)
    made = {id_col: public_id().cast(kinds[id_col]), text_col: F.col("_text")}
    if "n_chars" in kinds:
        made["n_chars"] = F.length("_text").cast(kinds["n_chars"])
    return rows.select(*[(made[c] if c in made else F.col(f"_keep.`{c}`")).alias(c) for c in docs.columns])


def for_each_row(result: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeat results of (doc_id, _h) as often as the input has the row; without _h."""
    rows = texts(docs, id_col, text_col)
    if not rows.groupBy("_id").count().where("count > 1").limit(1).count():
        return result.drop("_h")
    counted = rows.groupBy(public_id().alias("_public"), F.xxhash64("_text").alias("_tag")).count()
    same = result["doc_id"].eqNullSafe(counted["_public"]) & (result["_h"] == counted["_tag"])
    each = F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))
    return result.join(counted, same).withColumn("_copy", each).drop("_copy", "count", "_public", "_tag", "_h")


def public_id(column: str = "_id") -> Column:
    """The id as it came in."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(struct(ddl))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Stored:
    """Intermediate tables in the folder the cluster names in spark.checkpoint.dir.

    They cut the lineage as a checkpoint does, but column-wise and compressed.
    ``drop`` removes one as soon as a later one has replaced it.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.base = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
        self.made = 0

    def folder(self) -> str:
        self.made += 1
        return f"{self.base}/{self.made}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.folder()
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stored_at = path
        return back

    def drop(self, df: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
