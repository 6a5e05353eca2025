"""The exploration run over a bar table: profile, clean, scale, decompose."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.blocks import MAX_ROWS
from barloom.operators.prepare import Components, clean_bars, fit_components, minmax, price_series, scaled_bars, volume_series
from barloom.operators.profile import box_stats, describe, histogram, info, missing_check, numeric_columns
from barloom.sources.bars import bars_of_symbol, open_bars, read_day_file
from barloom.sources.schema import KEY


@dataclass
class Exploration:
    """Each step as a DataFrame, built when it is first asked for.

    ``symbol`` restricts the run to one symbol; without it, gaps are filled within
    each symbol and everything else covers the whole table.
    """

    bars: DataFrame
    symbol: int | None = None
    fill: bool = True
    max_rows: int | None = MAX_ROWS

    @classmethod
    def of_file(cls, spark: SparkSession, path: str, symbol: int | None = None, **options) -> "Exploration":
        """One day's file."""
        return cls(read_day_file(spark, path), symbol, **options)

    @classmethod
    def of_directory(cls, spark: SparkSession, root: str, symbol: int | None = None, **options) -> "Exploration":
        """All days of a date-partitioned directory; the symbol filter reaches the scan."""
        return cls(open_bars(spark, root), symbol, **options)

    @cached_property
    def data(self) -> DataFrame:
        return self.bars if self.symbol is None else bars_of_symbol(self.bars, self.symbol)

    @cached_property
    def values(self) -> list[str]:
        return numeric_columns(self.bars, KEY)

    def info(self) -> DataFrame:
        return info(self.data)

    def describe(self, approx: bool = False) -> DataFrame:
        return describe(self.data, approx=approx)

    def prices(self) -> DataFrame:
        return price_series(self.data)

    def volumes(self) -> DataFrame:
        return volume_series(self.data)

    def histogram(self) -> DataFrame:
        return histogram(self.data)

    def box(self) -> DataFrame:
        return box_stats(self.data, self.values)

    @cached_property
    def cleaned(self) -> DataFrame:
        return clean_bars(self.data, fill=self.fill, max_rows=self.max_rows)

    @cached_property
    def scaled(self) -> DataFrame:
        return scaled_bars(self.data, self.values, self.max_rows) if self.fill else minmax(self.cleaned, self.values)

    def check(self) -> DataFrame:
        """Missing and infinite values left after scaling; all false when cleaning worked."""
        return missing_check(self.scaled, self.values)

    @cached_property
    def components(self) -> Components:
        return fit_components(self.scaled, self.values, shift=0.5)  # scaled values are between 0 and 1

    def scores(self) -> DataFrame:
        return self.components.scores(self.scaled)

    def loadings(self) -> DataFrame:
        return self.components.loadings(self.scaled)
