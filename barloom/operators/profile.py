"""Profiles of a table: info, describe, histogram, box-plot data, missing-value checks.

Every result is a small DataFrame with one row per column (or per bin); the
tables are reduced by partial aggregates and only numbers of columns x
statistics reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from barloom.functions.columns import clean
from barloom.operators.quantiles import quantiles
from barloom.sources.schema import KEY

BINS = 20
WHISKER = 1.5


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _per_column(df: DataFrame, rows: dict[str, list[Column]]) -> DataFrame:
    """One aggregate over df, laid out as a row per column with the given (aliased) statistics."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), *stats).alias(f"s{j}") for j, (c, stats) in enumerate(rows.items())])
    return wide.select(F.inline(F.array(*[f"s{j}" for j in range(len(rows))])))


def info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null) for each column. NaN counts as missing, infinity does not."""

    def present(name: str, dtype: str) -> Column:
        c = F.col(f"`{name}`")
        return F.count(F.when(~F.isnan(c), c) if dtype in ("double", "float") else c)

    return _per_column(df, {c: [F.lit(t).alias("dtype"), present(c, t).alias("non_null")] for c, t in df.dtypes})


def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max of each numeric column.

    Quartiles interpolate linearly and are exact; ``approx`` takes them from one
    sketch pass instead. NaN and infinities count as missing.
    """
    columns = numeric_columns(df) if columns is None else columns
    df = clean(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    names = ("p25", "p50", "p75")

    def others(c: str) -> list[Column]:
        return [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]

    order = ("column", "count", "mean", "std", "min", *names, "max")
    if approx:
        quart = {c: [F.percentile_approx(c, p, 10_000).alias(n) for p, n in zip((0.25, 0.5, 0.75), names)] for c in columns}
        return _per_column(df, {c: [*others(c), *quart[c]] for c in columns}).select(*order)
    if not columns:
        raise ValueError("no numeric columns")
    exact, rest = quantiles(df, columns, [0.25, 0.5, 0.75], extra={c: F.struct(*others(c)) for c in columns})
    # One row per column, made of what two or three passes have found.
    rows = [(c, rest[c]["count"], rest[c]["mean"], rest[c]["std"], rest[c]["min"], *exact[c], rest[c]["max"]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, " + ", ".join(f"{c} double" for c in order[2:]))


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """(column, bin, left, right, n): equal-width bins from min to max, the last one closed.

    A constant column gets the range of one around its value.
    """
    columns = numeric_columns(df) if columns is None else columns
    df = clean(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    bounds = _per_column(df, {c: [F.min(c).alias("lo"), F.max(c).alias("hi")] for c in columns}).where("lo is not null")
    bounds = bounds.selectExpr("column", "if(lo = hi, lo - 0.5D, lo) as lo", "if(lo = hi, hi + 0.5D, hi) as hi")
    bounds = bounds.selectExpr("*", f"(hi - lo) / {bins} as step")
    # One row per column: a broadcast of len(columns) rows.
    values = df.unpivot([], columns, "column", "value").where("value is not null").join(F.broadcast(bounds), "column")
    binned = values.selectExpr("column", "value", "lo", "step", f"least(cast(floor((value - lo) / step) as int), {bins - 1}) as b")
    # Edges are lo + k * step; move the values that the division put on the wrong side of one.
    counts = binned.selectExpr("column", f"""b - if(value < lo + b * step, 1, 0)
        + if(value >= lo + (b + 1) * step and b < {bins - 1}, 1, 0) as bin""").groupBy("column", "bin").agg(F.count("*").alias("n"))
    grid = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(F.broadcast(counts), ["column", "bin"], "left").selectExpr(
        "column", "bin", "lo + bin * step as left", f"if(bin = {bins - 1}, hi, lo + (bin + 1) * step) as right", "coalesce(n, 0L) as n"
    )


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, whisker ends and the number of outliers below and above them."""
    columns = numeric_columns(df, KEY[:1] + KEY[2:]) if columns is None else columns
    df = clean(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    rows = {}
    for c, (q1, med, q3) in quantiles(df, columns, [0.25, 0.5, 0.75]).items():
        if q1 is None:
            rows[c] = [F.lit(None).cast("double").alias(n) for n in ("q1", "median", "q3", "whisker_low", "whisker_high")] \
                + [F.lit(0).cast("bigint").alias(n) for n in ("outliers_low", "outliers_high")]
            continue
        lo, hi = q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1)
        rows[c] = [
            F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
            F.expr(f"least(min(if(`{c}` >= {lo!r}D, `{c}`, null)), {q1!r}D)").alias("whisker_low"),
            F.expr(f"greatest(max(if(`{c}` <= {hi!r}D, `{c}`, null)), {q3!r}D)").alias("whisker_high"),
            F.expr(f"count_if(`{c}` < {lo!r}D)").alias("outliers_low"),
            F.expr(f"count_if(`{c}` > {hi!r}D)").alias("outliers_high"),
        ]
    return _per_column(df, rows)


def missing_check(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, has_null, has_inf) for each numeric column; NaN counts as null."""
    columns = numeric_columns(df) if columns is None else columns
    return _per_column(df, {
        c: [
            F.expr(f"coalesce(bool_or(`{c}` is null or isnan(`{c}`)), false) as has_null"),
            F.expr(f"coalesce(bool_or(abs(cast(`{c}` as double)) = double('Infinity')), false) as has_inf"),
        ]
        for c in columns
    })
