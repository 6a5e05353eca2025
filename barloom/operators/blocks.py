"""Contiguous blocks of a symbol's series, so that one symbol may use many tasks.

Ordered windows cluster on ``symbol``. That is one shuffle and no more as long
as a symbol fits a task. A symbol with more than ``max_rows`` bars is cut into
blocks of about that many consecutive rows instead, and windows cluster on
(symbol, blk). Two things make the result the same as over the whole series:

* halo - the last rows before a block (and the first after it) are copied into
  it, enough for every fixed-length look-back; copies are dropped after the
  windows have run (``_own`` marks the originals);
* carry - running quantities are summed up per block, and the state at the end
  of each block is handed to the next (see ``ewm`` and ``fill``).

The cut points come from counts per (symbol, date), and per slice of a date
where one date alone is too big. Slices end at quantiles of the date's intervals, so
unevenly spaced rows make no big slice. Quantiles come from a sketch, whose result
depends on the order of merging; they are checkpointed, and all else is integer
arithmetic on keys, so a recomputed task sees the same blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from barloom.session import checkpointed
from barloom.sources.schema import KEY

MAX_ROWS = 4_000_000
BROADCAST_ROWS = 1_000_000
# A row's slice within its day: the number of cuts before it; a day without cuts is one slice.
SLICE = "if(_cuts is null, 0L, cast(size(filter(_cuts, c -> c < interval)) as bigint))"


@dataclass(frozen=True)
class Layout:
    """Where the days of the big symbols go, and the largest number of blocks there can be."""

    table: DataFrame
    days: int
    blocks: int


@dataclass(frozen=True)
class Series:
    """Bars keyed for ordered windows. A frame cut into blocks also holds _blk and _own."""

    df: DataFrame
    blocks: int = 0
    big: DataFrame | None = None  # the symbols that are cut, no more than blocks
    state: DataFrame | None = None  # what running quantities go on from, a row a symbol

    @property
    def blocked(self) -> bool:
        return self.blocks > 0

    @property
    def keys(self) -> list[str]:
        return ["symbol", "_blk"] if self.blocked else ["symbol"]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("date", "interval")

    def with_df(self, df: DataFrame) -> "Series":
        return Series(df, self.blocks, self.big, self.state)

    def cut(self) -> DataFrame:
        """Original rows of the symbols that are cut into blocks; only they hand anything on."""
        return self.df.where("_own").join(broadcast_up_to(self.big, self.blocks), "symbol", "left_semi")

    def own(self) -> DataFrame:
        return self.df.where("_own").drop("_own") if self.blocked else self.df


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if ``rows``, an upper bound of df's size, allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def series(bars: DataFrame, before: int = 0, after: int = 0, max_rows: int | None = MAX_ROWS) -> Series:
    """Key ``bars`` for windows that look ``before`` rows back and ``after`` rows ahead."""
    return place(bars, find_layout(bars, before, after, max_rows))


def find_layout(bars: DataFrame, before: int = 0, after: int = 0, max_rows: int | None = MAX_ROWS) -> Layout | None:
    """Cut points for the symbols with more than ``max_rows`` bars, None if there are none.

    Runs one small aggregate over ``symbol``; only if that finds a big symbol, a
    second one over the key columns. ``max_rows=None`` skips the check and takes
    it that every symbol fits a task.
    """
    bars = bars.where(F.col("symbol").isNotNull())
    if max_rows is None or (bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0) <= max_rows:
        return None
    days = bars.groupBy("symbol", "date").agg(F.count("*").alias("n"))
    big = (
        days.groupBy("symbol")
        .agg(F.sum("n").alias("total"), F.max("n").alias("day"), F.count("*").alias("days"))
        .where(F.col("total") > max_rows)
        .agg(F.sum("days").alias("days"), F.max("day").alias("day"), F.sum(F.ceil(F.col("total") / max_rows)).alias("blocks"))
        .first()
    )
    target = max(1, max_rows // 4)
    table = _layout(bars, days, max_rows, target, big["day"], before, after)
    return Layout(table, big["days"], big["blocks"])


def place(bars: DataFrame, layout: Layout | None, state: DataFrame | None = None, states: int = 0) -> Series:
    """Bars with their block, copied where a neighbouring block looks at them.

    Rows without a symbol belong to no series and are dropped. With ``state`` (``states`` rows), rows whose
    ``_given`` is false come from before the series and are looked back at only.
    """
    bars = bars.where(F.col("symbol").isNotNull())
    if layout is None and state is None:
        return Series(bars)
    if layout is None:
        return Series(bars.selectExpr("*", "0L as _blk", "_given as _own").drop("_given"), max(states, 1), None, state)
    placed = (
        bars.join(broadcast_up_to(layout.table, layout.days), ["symbol", "date"], "left")
        .withColumn("_slice", F.expr(SLICE))
        .withColumn("_dest", F.coalesce(F.expr("_dests[cast(_slice as int)]"), F.array(F.lit(0).cast("bigint"))))
        .select(*bars.columns, F.posexplode("_dest").alias("_pos", "_blk"))
        .withColumn("_own", (F.col("_pos") == 0) & (F.lit(True) if state is None else F.col("_given")))
        .drop("_pos", "_given")
    )
    return Series(placed, layout.blocks + states, layout.table.select("symbol").distinct(), state)


def _layout(bars, days, max_rows, target, longest, before, after) -> DataFrame:
    """(symbol, date, _cuts, _dests) for each day of a symbol above ``max_rows``.

    ``_dests[slice]`` lists the blocks a slice goes to, its own block first.
    """
    of_symbol = Window.partitionBy("symbol")
    days = days.withColumn("_total", F.sum("n").over(of_symbol)).where(F.col("_total") > max_rows).drop("_total")
    if longest > target:
        pieces = -(-longest * 4 // target)
        shares = [i / pieces for i in range(1, pieces)]
        cuts = F.percentile_approx("interval", shares, max(10_000, 20 * pieces))
        rows = bars.select(*KEY).join(days.where(F.col("n") > target).select("symbol", "date"), ["symbol", "date"], "left_semi")
        cuts = checkpointed(rows.groupBy("symbol", "date").agg(F.array_sort(F.array_distinct(cuts)).alias("_cuts")))
        slices = (
            rows.join(cuts, ["symbol", "date"])
            .withColumn("_slice", F.expr(SLICE))
            .groupBy("symbol", "date", "_cuts", "_slice")
            .agg(F.count("*").alias("n"))
        )
        whole = days.where(F.col("n") <= target).select(
            "symbol", "date", F.lit(None).cast(cuts.schema["_cuts"].dataType).alias("_cuts"), F.lit(0).cast("bigint").alias("_slice"), "n")
        slices = slices.unionByName(whole)
    else:
        slices = days.select(
            "symbol", "date", F.lit(None).cast("array<bigint>").alias("_cuts"), F.lit(0).cast("bigint").alias("_slice"), "n")

    ordered = of_symbol.orderBy("date", "_slice")
    placed = (
        slices.withColumn("_end", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("n"))
        .withColumn("_blk", F.expr(f"_start div {max_rows}"))
        .withColumn("_prev_blk", F.lag("_blk").over(ordered))
        .withColumn("_next_blk", F.lead("_blk").over(ordered))
    )
    dest = F.array("_blk")
    if before:
        # Blocks that begin less than `before` rows past the end of this slice.
        near = of_symbol.orderBy("_end").rangeBetween(0, before - 1)
        dest = F.array_union(dest, F.collect_set("_next_blk").over(near))
    if after:
        # Blocks that end less than `after` rows ahead of the start of this slice.
        near = of_symbol.orderBy("_start").rangeBetween(1 - after, 0)
        dest = F.array_union(dest, F.collect_set("_prev_blk").over(near))
    return (
        placed.withColumn("_dest", dest)
        .groupBy("symbol", "date", "_cuts")
        .agg(F.map_from_entries(F.collect_list(F.struct("_slice", "_dest"))).alias("_by_slice"), F.max("_slice").alias("_top"))
        .select(
            "symbol", "date", "_cuts",
            F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_top")), lambda i: F.try_element_at("_by_slice", i)).alias("_dests"),
        )
    )
