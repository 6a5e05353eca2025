"""Bars stored the way the features read them: bucketed by symbol, with the block table beside.

A table read whole day after day is shuffled by symbol each time, and its symbols are counted to find those
too big for a task. Both are done once here: files are bucketed by symbol and sorted within, and what counting
finds is stored beside them. The 62-feature plan over such a table has no exchange and starts no
job before its own.

Below the folder: ``bars`` (the buckets), ``facts`` (one row: number of buckets, rows of the largest symbol, size of
the block table, columns) and, if a symbol is cut, ``blocks`` (where its days go). Spark keeps bucketing in its
catalogue only, so opening the folder declares the table again, from ``facts``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.blocks import MAX_ROWS, Layout, find_layout
from barloom.plans.features import RETURN_LAG, clean_rows, features
from barloom.session import folder_exists
from barloom.sources.schema import KEY

FACTS_DDL = "buckets int, max_rows bigint, most_rows bigint, days bigint, blocks bigint, columns string"


def _name(root: str) -> str:
    return "bars_" + hashlib.md5(root.rstrip("/").encode()).hexdigest()[:16]


@dataclass(frozen=True)
class StoredBars:
    """A bucketed bar table, and the layout its features need: None if every symbol fits a task."""

    bars: DataFrame
    layout: Layout | None
    buckets: int

    def features(self, names: list[str] | None = None, **options) -> DataFrame:
        return features(self.bars, names, layout=self.layout, **options)


def write_layout(bars: DataFrame, root: str, buckets: int | None = None, max_rows: int = MAX_ROWS) -> StoredBars:
    """Store ``bars`` below ``root``, in place of what was there. The bars must not be read from there.

    Rows come to the writers by symbol; a big symbol's share is split over several by AQE, and then has
    several files in its bucket.
    """
    spark = bars.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"drop table if exists {_name(root)}")
    (bars.hint("rebalance", "symbol").write.mode("overwrite").format("parquet").option("path", f"{root}/bars")
     .bucketBy(buckets, "symbol").sortBy(*KEY).saveAsTable(_name(root)))
    stored = spark.table(_name(root))
    raw = clean_rows(stored)
    most = raw.where("symbol is not null").groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    layout = find_layout(raw, before=RETURN_LAG, max_rows=max_rows) if most > max_rows else None
    if layout is not None:
        layout.table.write.mode("overwrite").parquet(f"{root}/blocks")
    columns = ", ".join(f"`{c}` {t}" for c, t in stored.dtypes)
    facts = (buckets, max_rows, most, layout.days if layout else 0, layout.blocks if layout else 0, columns)
    spark.createDataFrame([facts], FACTS_DDL).coalesce(1).write.mode("overwrite").parquet(f"{root}/facts")
    return open_layout(spark, root)


def open_layout(spark: SparkSession, root: str) -> StoredBars:
    """A table that ``write_layout`` stored, in any session."""
    if not folder_exists(spark, f"{root}/facts/_SUCCESS"):
        raise ValueError(f"no stored bars: {root}")
    facts = spark.read.parquet(f"{root}/facts").first()
    spark.sql(f"""create table if not exists {_name(root)} ({facts['columns']}) using parquet
        clustered by (symbol) sorted by ({', '.join(f'`{c}`' for c in KEY)}) into {facts['buckets']} buckets location '{root}/bars'""")
    if not facts["blocks"]:
        return StoredBars(spark.table(_name(root)), None, facts["buckets"])
    # Blocks are dealt anew: the plain files, so that the tasks share the scan of a big symbol's bucket.
    layout = Layout(spark.read.parquet(f"{root}/blocks"), facts["days"], facts["blocks"])
    return StoredBars(spark.read.schema(facts["columns"]).parquet(f"{root}/bars"), layout, facts["buckets"])
