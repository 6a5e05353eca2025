"""Cleaning, scaling and principal components of bar tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from barloom.functions.columns import clean
from barloom.operators.blocks import MAX_ROWS, series
from barloom.operators.moments import moments
from barloom.operators.profile import numeric_columns
from barloom.operators.windows import fill_both

# The lunch break within a day's HHMMSS, both ends dropped.
LUNCH_START, LUNCH_END, DAY_DIGITS = 113000, 130000, 1000000

PRICE_SERIES = ("midpx", "open", "high", "low", "lastpx")
VOLUME_SERIES = ("tradeBuyQty", "tradeSellQty")


def price_series(bars: DataFrame) -> DataFrame:
    return _series_view(bars, PRICE_SERIES)


def volume_series(bars: DataFrame) -> DataFrame:
    return _series_view(bars, VOLUME_SERIES)


def _series_view(bars: DataFrame, columns) -> DataFrame:
    return bars.select("symbol", "date", "interval", *columns).orderBy("symbol", "date", "interval")


def drop_lunch(bars: DataFrame) -> DataFrame:
    """Rows outside the lunch break; a row without interval stays."""
    return bars.where(f"not coalesce(interval % {DAY_DIGITS} between {LUNCH_START} and {LUNCH_END}, false)")


def fill_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column mean over df; a column without any value is an error."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    empty = [c for c in columns if means[c] is None]
    if empty:
        raise ValueError(f"columns without any value: {empty}")
    return df.withColumns({c: F.coalesce(c, F.lit(means[c])) for c in columns})


@dataclass(frozen=True)
class Counts:
    """What one aggregate per symbol, and one over its results, tells about the rows outside the lunch break."""

    most_rows: int  # of one symbol
    open_columns: list[str]  # without a value in some symbol
    halves: dict[str, tuple[float, float] | None]  # extremes, halved
    whole: bool  # no row lacks its place in a series or a value of another kind


KEYS = ("symbol", "date", "interval")


def count_bars(bars: DataFrame) -> Counts:
    """One pass, aggregated by symbol; a column without any value is an error."""
    kept = drop_lunch(clean(bars)).where("symbol is not null")
    columns = numeric_columns(kept, KEYS)
    others = [c for c in bars.columns if c not in columns and c != "symbol"]
    numbers = {c: f"c{i}" for i, c in enumerate(columns)}
    per_symbol = kept.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.count_if(F.expr(" or ".join(["false", *[f"`{c}` is null" for c in others]]))).alias("gaps"),
        *[F.count(f"`{c}`").alias(f"n_{a}") for c, a in numbers.items()],
        *[f(_half(c)).alias(f"{name}_{a}") for c, a in numbers.items() for name, f in (("lo", F.min), ("hi", F.max))])
    row = per_symbol.agg(
        F.max("rows").alias("rows"), F.sum("gaps").alias("gaps"),
        *[f(f"{name}_{a}").alias(f"{out}_{a}") for a in numbers.values()
          for out, name, f in (("least", "n", F.min), ("most", "n", F.max), ("lo", "lo", F.min), ("hi", "hi", F.max))]).first()
    empty = [c for c, a in numbers.items() if row[f"most_{a}"] == 0]
    if empty:
        raise ValueError(f"columns without any value: {empty}")
    halves = {c: None if row[f"lo_{a}"] is None else (row[f"lo_{a}"], row[f"hi_{a}"]) for c, a in numbers.items()}
    return Counts(row["rows"] or 0, [c for c, a in numbers.items() if row[f"least_{a}"] == 0], halves, not row["gaps"])


def clean_bars(bars: DataFrame, fill: bool = True, max_rows: int | None = MAX_ROWS, counts: Counts | None = None) -> DataFrame:
    """Infinities to missing, lunch break out, gaps filled, incomplete rows out.

    Gaps are filled forward, then backward, in (date, interval) order of each
    symbol; the column mean over the table fills what is left. ``fill=False``
    only drops the lunch break and incomplete rows, and leaves infinities alone.
    The columns that need the mean, and the size of the symbols, come from one pass (``count_bars``).
    """
    if not fill:
        kept = drop_lunch(bars)
        floats = [c for c, t in kept.dtypes if t in ("double", "float")]
        return kept.where(" and ".join(f"not isnan(`{c}`)" for c in floats)).dropna("any") if floats else kept.dropna("any")
    counts = counts or count_bars(bars)
    kept = drop_lunch(clean(bars))
    columns = numeric_columns(kept, KEYS)
    known = max_rows if max_rows is not None and counts.most_rows > max_rows else None
    filled = fill_both(series(kept, max_rows=known), columns).own().select(*bars.columns)
    # A symbol keeps a gap only in a column it has no value for at all.
    if counts.open_columns:
        filled = fill_mean(filled, counts.open_columns)
    return filled.dropna("any")


def _half(c: str):
    value = F.col(f"`{c}`").cast("double")
    return F.when(F.abs(value) < float("inf"), value / 2)  # NaN is above every number


def minmax(df: DataFrame, columns: list[str] | None = None, halves: dict | None = None) -> DataFrame:
    """Scale columns to [0, 1] by their extremes over df; a constant column becomes 0, infinities are missing.

    One aggregate finds the extremes unless their ``halves`` are given; the scaling itself is a projection, on halves,
    whose differences cannot overflow.
    """
    columns = numeric_columns(df, ("symbol", "interval")) if columns is None else columns
    if halves is None:
        ends = df.agg(*[F.struct(F.min(_half(c)).alias("lo"), F.max(_half(c)).alias("hi")).alias(c) for c in columns]).first()
        halves = {c: tuple(ends[c]) for c in columns}

    def scaled(c: str):
        lo, hi = halves[c] or (None, None)
        if lo is None:
            return F.lit(None).cast("double")
        return (_half(c) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.when(_half(c).isNotNull(), 0.0)

    return df.withColumns({c: scaled(c) for c in columns})


def scaled_bars(bars: DataFrame, columns: list[str] | None = None, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """``minmax(clean_bars(bars))`` with one pass over the bars before the result's own.

    Filling copies values within a column and adds means, so it leaves the extremes as they are; only if
    rows go because they lack a key or a value of another kind are the extremes looked for again.
    """
    counts = count_bars(bars)
    columns = numeric_columns(bars, ("symbol", "interval")) if columns is None else columns
    known = counts.whole and set(columns) <= set(counts.halves)
    return minmax(clean_bars(bars, max_rows=max_rows, counts=counts), columns, counts.halves if known else None)


@dataclass
class Components:
    """A fitted PCA. Components are signed so that their largest loading is positive."""

    columns: list[str]
    loadings_table: list[tuple[str, list[float]]]
    explained: list[float]
    means: list[float]

    def loadings(self, df: DataFrame) -> DataFrame:
        """(feature, PC1, PC2, ...); at most one row per input column."""
        k = len(self.explained)
        schema = "feature string, " + ", ".join(f"PC{j + 1} double" for j in range(k))
        return df.sparkSession.createDataFrame([(c, *v) for c, v in self.loadings_table], schema)

    def sorted_loadings(self, df: DataFrame, component: int = 1) -> DataFrame:
        return self.loadings(df).select("feature", f"PC{component}").orderBy(F.desc(f"PC{component}"))

    def scores(self, df: DataFrame, keep: tuple[str, ...] = ("symbol", "date", "interval")) -> DataFrame:
        """Centred projections: a dot product per component on the fitted means."""
        def score(j: int):
            terms = [f"(`{c}` - {self.means[i]!r}D) * {v[j]!r}D" for i, (c, v) in enumerate(self.loadings_table)]
            return F.expr(" + ".join(terms)).alias(f"PC{j + 1}")

        return df.select(*[c for c in keep if c in df.columns], *[score(j) for j in range(len(self.explained))])


def fit_components(df: DataFrame, columns: list[str] | None = None, k: int = 2, shift: float | None = None) -> Components:
    """Principal components of the centred columns, from one pass of co-moments. Only p x p numbers reach the driver.

    ``shift``: a value near the means of all columns; without one they are looked for first.
    """
    columns = numeric_columns(df, KEYS) if columns is None else columns
    found = moments(df, columns, None if shift is None else [shift] * len(columns))
    if not found.rows or not found.complete:
        raise ValueError("components need rows, and a value in every column of each")
    values, vectors = np.linalg.eigh(found.covariance())
    values, pc = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :k].copy()
    for j in range(pc.shape[1]):
        if pc[abs(pc[:, j]).argmax(), j] < 0:
            pc[:, j] = -pc[:, j]
    explained = values[:k] / values.sum() if values.sum() > 0 else np.zeros(len(values[:k]))
    return Components(columns, [(c, [float(x) for x in pc[i]]) for i, c in enumerate(columns)],
                      [float(x) for x in explained], [float(x) for x in found.mean])
