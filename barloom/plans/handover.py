"""What one date range hands to the next, so that features go on as over one long range.

A ``RangeState`` holds, for each symbol, its last bars (enough for every look-back), the
weighted sums of each exponentially weighted mean as of its last bar, and, for each group that
shares a mean return, the sum and count of the returns so far. ``features`` takes such a state up: its bars are
looked back at but not returned, the means start from the sums, and ``lagret12`` is measured
against the mean over all ranges so far. A symbol that does not trade in a range keeps its state.

The state has a row per symbol and per group, however long the ranges were. It is stored as
Parquet in a folder of its own for the day it is as of, so a range can be run again from the state before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.operators.windows import ewm
from barloom.plans import features as plan
from barloom.session import folder_exists
from barloom.sources.schema import BAR_COLUMNS, KEY

ROWS = plan.RETURN_LAG  # bars kept of each symbol: the longest look-back


@dataclass(frozen=True)
class RangeState:
    """``series``: symbol, bars, n_/d_/e_<mean>; ``means``: symbol (if the mean is the symbol's), interval, total, rows."""

    series: DataFrame
    means: DataFrame
    mean_scope: str = "symbol"

    def write(self, root: str, day: int | str) -> None:
        """Replace the state as of ``day``."""
        folder = f"{root}/upto={int(day)}"
        self.means.withColumn("scope", F.lit(self.mean_scope)).write.mode("overwrite").parquet(f"{folder}/means")
        self.series.write.mode("overwrite").parquet(f"{folder}/series")  # last: a state with series is complete

    @classmethod
    def read(cls, spark: SparkSession, root: str, day: int | str) -> "RangeState | None":
        """The state as of ``day``; None if there is none."""
        folder = f"{root}/upto={int(day)}"
        if not folder_exists(spark, f"{folder}/series/_SUCCESS"):
            return None
        means = spark.read.parquet(f"{folder}/means")
        return cls(spark.read.parquet(f"{folder}/series"), means.drop("scope"), "symbol" if "symbol" in means.columns else "universe")


def range_state(bars: DataFrame, state: RangeState | None = None, mean_scope: str = "symbol", max_rows: int | None = plan.MAX_ROWS) -> RangeState:
    """The state after ``bars``, which follow ``state``. Reads the columns of the means and look-backs, in passes of its own."""
    if state is not None and state.mean_scope != mean_scope:
        raise ValueError(f"the state holds means of scope {state.mean_scope!r}")
    raw = plan.given_rows(plan.clean_rows(bars), state)
    layout = plan.find_layout(raw, before=ROWS, max_rows=max_rows)

    # The last bars of each symbol, earlier ones of the state included.
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("interval")))
    kept = raw.where("symbol is not null").withColumn("_nth", last).where(F.col("_nth") <= ROWS)
    bar = F.struct("date", "interval", *BAR_COLUMNS)
    rows = kept.groupBy("symbol").agg(F.sort_array(F.collect_list(bar)).alias("bars"))

    s = plan.placed(raw, layout, state)
    s = plan.index_rows(s)
    s = s.with_df(s.df.selectExpr("*", f"{plan.imbalance(*plan.QUANTITIES)} as trade_imb"))
    specs = plan.weighted_means()
    s = ewm(s, specs, sums_too=True)
    numbers = [f"{p}_{out}" for out in specs for p in "nde"]
    end = F.struct(*[F.col(f"{p}_{out}") if p != "e" else F.col(out).alias(f"e_{out}") for out in specs for p in "nde"])
    ends = s.own().groupBy("symbol").agg(F.max_by(end, F.struct("date", "interval")).alias("_end")).select("symbol", "_end.*")
    if state is not None:
        idle = state.series.select("symbol", *numbers).join(ends.select("symbol"), "symbol", "left_anti")
        ends = ends.select("symbol", *numbers).unionByName(idle)
    means = plan.mean_sums(raw, layout, mean_scope, True, state)
    return RangeState(rows.join(ends, "symbol"), means, mean_scope)
