"""Bars derived from an event stream table, with a forward-return label.

One bar per instrument and hour. Users are grouped into instruments of
``USERS_PER_SYMBOL``, so the number of bars grows with the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.blocks import MAX_ROWS, series
from barloom.sources.schema import LABEL

USERS_PER_SYMBOL = 15
FIRST_SYMBOL = 90_000_000
LABEL_LEAD = 12


def bars_from_events(events: DataFrame) -> DataFrame:
    """Hourly bars without label. Aggregates partially before the one shuffle."""
    kind, value = F.col("event_type"), F.col("value")
    whole = F.floor("value").cast("bigint")

    def total(of: Column, *kinds: str) -> Column:
        # Integer sums do not depend on the order of addition.
        return F.sum(F.when(kind.isin(*kinds), of).otherwise(F.lit(0))).cast("double")

    one = F.lit(1)
    bars = events.groupBy(
        F.expr(f"cast({FIRST_SYMBOL} + user_id div {USERS_PER_SYMBOL} as bigint)").alias("symbol"),
        (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("int").alias("date"),
        (F.hour("ts") * 10000).cast("bigint").alias("interval"),
    ).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("lastpx"),
        F.min("value").alias("bid0"),
        (F.max("value") + F.lit(0.01)).alias("ask0"),
        total(whole, "purchase").alias("tradeBuyQty"),
        total(whole, "click").alias("tradeSellQty"),
        total(one, "view").alias("asize0"),
        total(one, "error").alias("bsize0"),
        total(whole, "view").alias("asize0_4"),
        total(whole, "error").alias("bsize0_4"),
        total(one, "view", "click").alias("asize5_9"),
        total(one, "error", "purchase").alias("bsize5_9"),
        total(one, "signup").alias("cxlSellQty"),
        total(whole, "signup").alias("cxlSellTurnover"),
        F.max(F.when(kind == "signup", value)).alias("cxlSellHigh"),
    )
    return bars.withColumn("midpx", (F.col("bid0") + F.col("ask0")) / 2)


def forward_return(bars: DataFrame, lead: int = LABEL_LEAD, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add the label: return of ``midpx`` over the next ``lead`` bars of the symbol."""
    s = series(bars, after=lead, max_rows=max_rows)
    ahead = F.lead("midpx", lead).over(s.window())
    df = s.df.withColumn(LABEL, F.try_divide(ahead, F.col("midpx")) - 1)
    return s.with_df(df).own().select(*bars.columns, LABEL)


def labelled_bars(events: DataFrame) -> DataFrame:
    return forward_return(bars_from_events(events))
