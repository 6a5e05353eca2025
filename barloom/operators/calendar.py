"""Trading-calendar lookups as equi-joins.

Dates are integers yyyymmdd. The calendar is widened to one row per integer
between its first and last day, each row already holding the neighbours of that
integer, so every lookup is a single hash join on the probe date. The widened
table has 10,000 rows per calendar year whatever the fact table holds; it is
broadcast only below ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BROADCAST_ROWS = 2_000_000


def _steps():
    return Window.orderBy("_day")


def _step(n: int) -> Column:
    """The trading day n steps from the current one."""
    return (F.lead("_real", n) if n >= 0 else F.lag("_real", -n)).over(_steps())


def _steps_between(a: int, b: int) -> Column:
    return F.collect_list("_real").over(_steps().rowsBetween(a, b))


def _positive(n: int) -> None:
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"the number of days must be a positive integer, got {n!r}")


class TradingCalendar:
    """Ordered distinct trading days: ``days`` is (trading_day int, idx int from 0)."""

    def __init__(self, days: DataFrame):
        # The calendar is a few hundred rows a year, so one ordered window task is enough.
        order = Window.orderBy("trading_day")
        self.days = days.select("trading_day", (F.row_number().over(order) - 1).alias("idx"))
        self._bounds: tuple[int, int] | None = None

    @classmethod
    def from_column(cls, df: DataFrame, column: str) -> "TradingCalendar":
        day = F.col(column).cast("int")
        return cls(df.select(day.alias("trading_day")).where(day.isNotNull()).distinct())

    @classmethod
    def from_text(cls, spark: SparkSession, path: str) -> "TradingCalendar":
        """A text file or directory with one yyyymmdd per line."""
        return cls.from_column(spark.read.text(path).where(F.trim("value") != "")
                               .select(F.trim("value").alias("value")), "value")

    @property
    def bounds(self) -> tuple[int, int]:
        """First and last trading day (one small aggregate, evaluated once)."""
        if self._bounds is None:
            lo, hi = self.days.agg(F.min("trading_day"), F.max("trading_day")).first()
            if lo is None:
                raise ValueError("the calendar has no days")
            self._bounds = (lo, hi)
        return self._bounds

    # -- one value per probe date -------------------------------------------------

    def is_trading_day(self, df: DataFrame, date: str = "date", out: str = "is_trading_day") -> DataFrame:
        looked = self._lookup(df, date, out, F.lit(True), F.lit(False))
        return looked.withColumn(out, F.coalesce(F.col(out), F.lit(False)))

    def to_trading_day(self, df: DataFrame, date: str = "date", out: str = "trading_day") -> DataFrame:
        """First trading day >= date; NULL past the last one."""
        return self._lookup(df, date, out, _step(0), _step(1))

    def next(self, df: DataFrame, date: str = "date", out: str = "next_day") -> DataFrame:
        """First trading day > date; NULL if there is none."""
        return self._lookup(df, date, out, _step(1), _step(1))

    def prev(self, df: DataFrame, date: str = "date", out: str = "prev_day") -> DataFrame:
        """Last trading day < date; NULL if there is none."""
        return self._lookup(df, date, out, _step(-1), _step(0))

    def shift(self, df: DataFrame, n: int, date: str = "date", out: str = "shifted_day") -> DataFrame:
        """The day ``n`` places from the first trading day >= date.

        NULL off either end, and for dates at or before the first trading day.
        """
        if not isinstance(n, int) or isinstance(n, bool):
            raise ValueError(f"shift needs an integer, got {n!r}")
        looked = self._lookup(df, date, out, _step(n), _step(n + 1))
        return looked.withColumn(out, F.when(F.col(date).cast("int") > F.lit(self.bounds[0]), F.col(out)))

    # -- several values per probe date --------------------------------------------

    def prevn(self, df: DataFrame, n: int, date: str = "date", out: str = "prev_day") -> DataFrame:
        """One row per trading day among the ``n`` last ones before date."""
        _positive(n)
        on_day, between = _steps_between(-n, -1), _steps_between(1 - n, 0)
        return self._lookup(df, date, out, on_day, between).withColumn(out, F.explode(out))

    def nextn(self, df: DataFrame, n: int, date: str = "date", out: str = "next_day") -> DataFrame:
        """One row per trading day among the ``n`` first ones after date."""
        _positive(n)
        ahead = _steps_between(1, n)
        return self._lookup(df, date, out, ahead, ahead).withColumn(out, F.explode(out))

    def _lookup(self, df: DataFrame, date: str, out: str, on_day: Column, between: Column) -> DataFrame:
        """Left-join ``out`` to df: ``on_day`` where date is a trading day, else ``between``.

        Both are windows over the steps of the calendar: one row per trading day
        plus a head row one below the first. They are evaluated there, then each
        step is widened to the integers up to the next one. Probes outside the
        calendar are moved to the integer just outside its ends.
        """
        first, last = self.bounds
        head = self.days.sparkSession.range(1).select(F.lit(first - 1).alias("_day"), F.lit(None).cast("int").alias("_real"))
        wide = (
            self.days.select(F.col("trading_day").alias("_day"), F.col("trading_day").alias("_real"))
            .unionByName(head)
            .select(
                "_day",
                "_real",
                F.coalesce(F.lead("_day").over(_steps()), F.lit(last + 2)).alias("_until"),
                on_day.alias("_on"),
                between.alias("_between"),
            )
            .withColumn("_probe", F.explode(F.sequence("_day", F.col("_until") - 1)))
            .select("_probe", F.when(F.col("_probe") == F.col("_real"), F.col("_on")).otherwise(F.col("_between")).alias(out))
        )
        if last - first < BROADCAST_ROWS:
            wide = F.broadcast(wide)
        probe = F.least(F.greatest(F.col(date).cast("int"), F.lit(first - 1)), F.lit(last + 1))
        keyed = df.withColumn("_probe", F.when(F.col(date).isNotNull(), probe))
        return keyed.join(wide, "_probe", "left").drop("_probe")

    # -- ranges -------------------------------------------------------------------

    def range(self, start: int | str, end: int | str) -> DataFrame:
        """Trading days in [start, end], both ends included."""
        return self.days.where(F.col("trading_day").between(int(start), int(end)))

    def range_list(self, start: int | str, end: int | str) -> list[int]:
        """The same as a list; an inverted range or one past the last day is an error."""
        start, end = int(start), int(end)
        if start > end:
            raise ValueError(f"start {start} is after end {end}")
        if start > self.bounds[1]:
            raise ValueError(f"no trading day from {start} on")
        return [r[0] for r in self.range(start, end).orderBy("trading_day").select("trading_day").collect()]

    def days_before(self, date: int | str, n: int) -> list[int]:
        """Up to ``n`` trading days before one date, ascending."""
        rows = (self.days.where(F.col("trading_day") < int(date))
                .orderBy(F.desc("trading_day")).limit(n).select("trading_day").collect())
        return sorted(r[0] for r in rows)
