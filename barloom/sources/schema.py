"""The bar table: names, types and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

KEY = ("symbol", "date", "interval")
LABEL = "fret12"
FORECAST = "forecast"

# The numeric columns of a bar file.
BAR_COLUMNS = (
    "open", "high", "low", "lastpx", "midpx", "bid0", "ask0",
    "tradeBuyQty", "tradeSellQty",
    "asize0", "bsize0", "asize0_4", "bsize0_4", "asize5_9", "bsize5_9",
    "cxlSellHigh", "cxlSellTurnover", "cxlSellQty",
)

BAR_SCHEMA = StructType(
    [
        StructField("symbol", LongType(), False),
        StructField("interval", LongType(), False),
        StructField("date", IntegerType(), False),
        *[StructField(c, DoubleType(), True) for c in (*BAR_COLUMNS, LABEL)],
    ]
)


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack the columns {missing}")
    return df


def duplicate_keys(bars: DataFrame) -> DataFrame:
    """Keys that occur more than once; windows need (symbol, date, interval) unique."""
    return bars.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def require_unique_keys(bars: DataFrame) -> DataFrame:
    """Raise if a key occurs twice. Shuffles the keys once; meant for new data."""
    found = duplicate_keys(bars).limit(1).collect()
    if found:
        raise ValueError(f"duplicate key {tuple(found[0])[:3]}")
    return bars


def bars_first(df: DataFrame) -> DataFrame:
    """symbol, interval, date first, then the rest in their own order."""
    lead = ["symbol", "interval", "date"]
    return df.select(*lead, *[c for c in df.columns if c not in lead])
