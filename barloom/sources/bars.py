"""Scans and writes of a bar table stored as Parquet partitioned by ``date``.

One scan with a predicate on the partition column stands for any number of day
files: Spark prunes the partitions and reads only the columns a query uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from barloom.operators.blocks import broadcast_up_to
from barloom.operators.calendar import TradingCalendar
from barloom.sources.days import day_folders, read_by_name, require_days
from barloom.sources.schema import BAR_SCHEMA, bars_first, require_columns


def open_bars(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """The whole table, lazily; extra columns are kept, missing ones are an error.

    Without a schema the columns of all days are matched by name, from the footers of their files.
    """
    try:
        df = read_by_name(spark, root) if schema is None else spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        raise ValueError(f"not a readable bar directory: {root}") from e
    required = [f.name for f in (schema or BAR_SCHEMA).fields]
    return bars_first(require_columns(df, required).withColumn("date", F.col("date").cast("int")))


def bars_on(bars: DataFrame, calendar: TradingCalendar, dates: Iterable[int | str], look: bool = False) -> DataFrame:
    """Rows of the given trading days. An empty list, a non-trading day or a day without a file is an error."""
    days = sorted({int(d) for d in dates})
    if not days:
        raise ValueError("no dates given")
    known = {r[0] for r in calendar.days.where(F.col("trading_day").isin(days)).select("trading_day").collect()}
    off = [d for d in days if d not in known]
    if off:
        raise ValueError(f"not trading days: {off}")
    return require_days(bars, days, look).where(F.col("date").isin(days))


def load_day(spark: SparkSession, root: str, calendar: TradingCalendar, date: int | str) -> DataFrame:
    return bars_on(open_bars(spark, root), calendar, [date])


def load_days(spark: SparkSession, root: str, calendar: TradingCalendar, dates: Iterable[int | str]) -> DataFrame:
    return bars_on(open_bars(spark, root), calendar, dates)


def bars_between(bars: DataFrame, calendar: TradingCalendar, start: int | str, end: int | str, look: bool = False) -> DataFrame:
    """Rows of the trading days in [start, end]; a trading day without a file is an error.

    Where the frame is not a stored table, ``look`` finds the days without rows by an
    aggregate over ``date``; otherwise only a stored table is checked. The two literals prune partitions at planning time; the semi-join on the
    small calendar then drops days that are not trading days.
    """
    start, end = int(start), int(end)
    if look or day_folders(bars) is not None:
        require_days(bars, [r[0] for r in calendar.range(start, end).select("trading_day").collect()], look)
    days = calendar.range(start, end).select(F.col("trading_day").alias("date"))
    days = broadcast_up_to(days, end - start + 1)
    return bars.where(F.col("date").between(start, end)).join(days, "date", "left_semi").select(*bars.columns)


def bars_of_symbol(bars: DataFrame, symbol: int) -> DataFrame:
    """All days of one symbol; the filter reaches the Parquet scan."""
    return bars.where(F.col("symbol") == F.lit(int(symbol)))


def read_day_file(spark: SparkSession, path: str, date: int | str | None = None) -> DataFrame:
    """One day stored as its own file, ``date`` taken from the argument or the name."""
    if date is None:
        found = re.search(r"(\d{8})(?:\.\w+)?/?$", path)
        if not found:
            raise ValueError(f"no yyyymmdd date in the file name: {path}")
        date = found.group(1)
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"not a readable bar file: {path}") from e
    return bars_first(df.withColumn("date", F.lit(int(date)).cast("int")))


def write_by_date(table: DataFrame, root: str, mode: str = "error") -> None:
    """Bars or features as date-partitioned Parquet.

    ``overwrite`` replaces the days that ``table`` holds and leaves all others as they are, so
    writing a day again gives the same table; ``replace_all`` drops what was there.
    Each task writes to a staging folder and the folders of the days are swapped when the
    job commits. Rows of one day are spread over several tasks by symbol, so a large day does
    not pass through one writer; AQE splits a hot symbol's share further.
    """
    kind = {"overwrite": "dynamic", "replace_all": "static"}.get(mode)
    writer = table.hint("rebalance", "date", "symbol").sortWithinPartitions("date", "symbol", "interval").write
    if kind is not None:
        mode, writer = "overwrite", writer.option("partitionOverwriteMode", kind)
    writer.mode(mode).partitionBy("date").parquet(root)
