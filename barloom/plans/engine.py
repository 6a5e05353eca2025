"""Fit on one date range, evaluate on another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.calendar import TradingCalendar
from barloom.plans.features import FEATURE_NAMES, features
from barloom.plans.handover import RangeState, range_state
from barloom.plans.metrics import metrics
from barloom.plans.models import BoostedTrees, Forecaster
from barloom.sources.bars import bars_between, open_bars
from barloom.sources.schema import require_unique_keys


class Engine:
    """Calendar, bars, feature plan and model in one place.

    ``warmup_days`` trading days before a range are read to fill the windows at
    its start and are not returned; 0 lets the windows start empty. The mean return
    that ``lagret12`` is measured against is taken over the warm-up rows too. A trading day of the
    range that a stored table has no file for is an error; ``look_for_days`` looks for
    days without rows in any other frame, at the cost of an aggregate over ``date``.

    With ``state_root`` a range goes on from the state stored there as of the trading day before it, if
    there is one; ``hand_over`` stores the state as of its end. ``plan`` must then take a ``state``.
    """

    def __init__(
        self,
        bars: DataFrame,
        calendar: TradingCalendar,
        model: Forecaster | None = None,
        plan: Callable[..., DataFrame] = features,
        warmup_days: int = 0,
        look_for_days: bool = False,
        state_root: str | None = None,
    ):
        if state_root and warmup_days:
            raise ValueError("a stored state takes the place of warm-up days")
        self.look_for_days, self.state_root = look_for_days, state_root
        self.bars, self.calendar, self.plan, self.warmup_days = bars, calendar, plan, warmup_days
        self.model = model or BoostedTrees(list(FEATURE_NAMES))

    @classmethod
    def open(cls, spark: SparkSession, root: str, calendar: TradingCalendar, check_keys: bool = False, **options) -> "Engine":
        """Bars from a date-partitioned directory; a missing one is a ValueError.

        ``check_keys`` looks for duplicate keys first, at the cost of one shuffle of the key columns.
        """
        bars = open_bars(spark, root)
        return cls(require_unique_keys(bars) if check_keys else bars, calendar, **options)

    def features(self, start: int | str, end: int | str) -> DataFrame:
        """Features of the trading days in [start, end]."""
        days = self.calendar.range_list(start, end)
        if not days:
            raise ValueError(f"no trading days in [{start}, {end}]")
        before = self.calendar.days_before(days[0], self.warmup_days) if self.warmup_days else []
        first = before[0] if before else days[0]
        bars = bars_between(self.bars, self.calendar, first, days[-1], self.look_for_days)
        df = self.plan(bars, state=self._before(days[0])) if self.state_root else self.plan(bars)
        return df.where(f"date >= {days[0]}") if before else df

    def _before(self, day: int) -> RangeState | None:
        earlier = self.calendar.days_before(day, 1)
        return RangeState.read(self.bars.sparkSession, self.state_root, earlier[0]) if earlier else None

    def hand_over(self, start: int | str, end: int | str) -> RangeState:
        """Store what the next range goes on from; running it again gives the same."""
        if not self.state_root:
            raise ValueError("no folder for states given")
        days = self.calendar.range_list(start, end)
        if not days:
            raise ValueError(f"no trading days in [{start}, {end}]")
        bars = bars_between(self.bars, self.calendar, days[0], days[-1], self.look_for_days)
        range_state(bars, self._before(days[0])).write(self.state_root, days[-1])
        return RangeState.read(self.bars.sparkSession, self.state_root, days[-1])

    def fit(self, start: int | str, end: int | str) -> "Engine":
        self.model.fit(self.features(start, end))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.predict(df)

    def eval(self, start: int | str, end: int | str) -> DataFrame:
        """One row of metrics (pcor, r2, mse, n)."""
        return metrics(self.predict(self.features(start, end)))
