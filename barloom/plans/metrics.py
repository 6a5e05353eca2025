"""Forecast metrics in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.columns import zero
from barloom.sources.schema import FORECAST, LABEL


def metrics(df: DataFrame, forecast: str = FORECAST, label: str = LABEL) -> DataFrame:
    """One row (pcor, r2, mse, n). Missing and infinite values count as 0.

    ``r2`` is 1 - SSE / var(label) / n with the n-1 variance. A constant side
    leaves the correlation NULL, a constant label leaves r2 NULL.
    """
    pair = df.selectExpr(f"{zero(f'`{forecast}`')} as f", f"{zero(f'`{label}`')} as y")
    sums = pair.agg(
        F.covar_samp("f", "y").alias("cov"), F.stddev_samp("f").alias("sf"), F.stddev_samp("y").alias("sy"),
        F.var_samp("y").alias("var"), F.sum(F.expr("(f - y) * (f - y)")).alias("sse"), F.count("*").alias("n"),
    )
    return sums.selectExpr(
        "try_divide(cov, sf * sy) as pcor", "1 - try_divide(sse, var * n) as r2", "try_divide(sse, n) as mse", "n"
    )


def summary_line(row) -> str:
    """The metrics row as one line of text."""

    def show(v, digits: int) -> str:
        return "nan" if v is None else f"{v:.{digits}f}"

    return f"Pearson correlation={show(row['pcor'], 4)}, R2={show(row['r2'], 5)}, MSE={show(row['mse'], 2)}"
