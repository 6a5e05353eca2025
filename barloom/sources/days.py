"""Which days a bar table holds, and what columns each of them has.

Both come from the directory: days from the file listing Spark has made anyway, schemas from
the footers of the files. No data is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType,
)

DAY = re.compile(r"/date=(\d{8})(?=/)")
READERS = 8  # day folders whose footers are asked for at once

# Each type and the wider ones that hold all its values, or as a table with gaps and a table of integers make doubles of both.
_ORDER = (ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType())


class SchemaConflict(ValueError):
    """Days have types of one column that no common type holds."""


def day_folders(bars: DataFrame) -> dict[int, str] | None:
    """{day: folder} of a date-partitioned table; None if the frame reads anything else, too."""
    found = {}
    for path in bars.inputFiles():
        m = DAY.search(path)
        if not m:
            return None
        found[int(m[1])] = path[: m.end()]
    return found or None


def absent_days(bars: DataFrame, days: Iterable[int], look: bool = False) -> list[int]:
    """Those of ``days`` that have no file.

    A frame that is not a plain date-partitioned table has no such listing; with ``look`` its
    distinct dates are counted instead, otherwise nothing is known to be absent.
    """
    days = sorted(set(days))
    folders = day_folders(bars)
    if folders is not None:
        return [d for d in days if d not in folders]
    if not look:
        return []
    met = {r[0] for r in bars.where(F.col("date").isin(days)).select("date").distinct().collect()}
    return [d for d in days if d not in met]


def require_days(bars: DataFrame, days: Iterable[int], look: bool = False) -> DataFrame:
    """Raise a ValueError that names the days without data."""
    absent = absent_days(bars, days, look)
    if absent:
        raise ValueError(f"no data for the trading days {absent}")
    return bars


# -- schemas ------------------------------------------------------------------------------


def wider(a: DataType, b: DataType) -> DataType | None:
    """The type that takes the values of both; None if there is none.

    Integers with floating numbers become doubles.
    """
    if a == b:
        return a
    if a not in _ORDER or b not in _ORDER:
        return None
    if (a in _ORDER[:4]) == (b in _ORDER[:4]):
        return max(a, b, key=_ORDER.index)
    return DoubleType()


def union_schema(schemas: dict[str, StructType]) -> StructType:
    """All columns in order of first appearance, each as wide as needed; ``schemas`` are keyed by what an error shall name."""
    merged: dict[str, tuple[DataType, str]] = {}
    for name, schema in schemas.items():
        for f in schema.fields:
            if f.name not in merged:
                merged[f.name] = f.dataType, name
                continue
            have, first = merged[f.name]
            both = wider(have, f.dataType)
            if both is None:
                raise SchemaConflict(f"column {f.name} is {have.simpleString()} in {first} and {f.dataType.simpleString()} in {name}")
            merged[f.name] = both, first
    return StructType([StructField(c, t) for c, (t, _) in merged.items()])


def _footers(spark: SparkSession, root: str, folders: list[str]) -> StructType | None:
    """One schema for all files of the folders, merged from their footers by a Spark job; None if types differ."""
    try:
        schema = spark.read.option("mergeSchema", True).option("basePath", root).parquet(*folders).schema
    except (PySparkException, Py4JJavaError) as e:  # this error reaches Python unconverted
        if "CANNOT_MERGE_SCHEMAS" in str(e):
            return None
        raise
    return StructType([f for f in schema.fields if f.name != "date"])


def _alike(spark: SparkSession, root: str, days: list[tuple[int, str]]) -> list[tuple[list[tuple[int, str]], StructType]]:
    """The days in runs whose footers merge; halves are tried until they do."""
    schema = _footers(spark, root, [folder for _, folder in days])
    if schema is not None:
        return [(days, schema)]
    if len(days) == 1:
        raise SchemaConflict(f"the files of {days[0][0]} differ in the type of a column")
    half = len(days) // 2
    return _alike(spark, root, days[:half]) + _alike(spark, root, days[half:])


def read_by_name(spark: SparkSession, root: str) -> DataFrame:
    """All days of a date-partitioned directory, columns matched by name.

    A column that a day lacks is NULL there; types are widened; types without a common one
    are a ``SchemaConflict``. If all days agree, this is one scan. If not, it is a scan
    for each kind of schema, cast and united by name; filters on ``date`` prune each of them.
    """
    folders = day_folders(spark.read.schema("symbol bigint").parquet(root))
    if folders is None:
        return spark.read.option("mergeSchema", True).parquet(root)
    days = sorted(folders.items())
    runs = _alike(spark, root, days)
    if len(runs) == 1:
        return spark.read.schema(runs[0][1]).option("basePath", root).parquet(root)
    kinds: dict[str, tuple[StructType, list[str], str]] = {}
    for run, schema in runs:
        name = schema.simpleString()
        kinds.setdefault(name, (schema, [], f"{run[0][0]}"))[1].extend(folder for _, folder in run)
    whole = union_schema({day: schema for schema, _, day in kinds.values()})
    out = None
    for schema, paths, _ in kinds.values():
        own = set(schema.names)
        part = spark.read.schema(schema).option("basePath", root).parquet(*paths)
        part = part.select(*[(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole.fields], "date")
        out = part if out is None else out.unionByName(part)
    return out


def schema_report(spark: SparkSession, root: str) -> DataFrame:
    """(column, dtype, days, first_day, last_day, missing_days): what the days of a directory differ in.

    One row for each type that a column has; ``missing_days`` counts the days without the column.
    """
    folders = day_folders(spark.read.schema("symbol bigint").parquet(root))
    if folders is None:
        raise ValueError(f"not partitioned by date: {root}")
    days = sorted(folders)
    with ThreadPoolExecutor(READERS) as pool:  # a footer job for each day; the jobs run on the executors
        schemas = list(pool.map(lambda d: _footers(spark, root, [folders[d]]), days))
    seen: dict[tuple[str, str], list[int]] = {}
    for day, schema in zip(days, schemas):
        if schema is None:
            raise SchemaConflict(f"the files of {day} differ in the type of a column")
        for f in schema.fields:
            seen.setdefault((f.name, f.dataType.simpleString()), []).append(day)
    have = {c: sum(len(v) for (name, _), v in seen.items() if name == c) for c, _ in seen}
    rows = [(c, t, len(v), v[0], v[-1], len(days) - have[c]) for (c, t), v in seen.items()]
    return spark.createDataFrame(rows, "column string, dtype string, days int, first_day int, last_day int, missing_days int")

