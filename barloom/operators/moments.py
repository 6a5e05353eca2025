"""Means, co-moments and extremes of many columns in one pass.

Each task sums up products of the differences from a fixed shift, for the rows where both columns
have a value; such sums add up in any order, so Spark merges them by plain sums. Means and centred
co-moments are algebra on p x p numbers afterwards. A shift near the means keeps the
differences small, so nothing is lost to cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_DDL = "i int, j int, s double, t double, n bigint, lo double, hi double"
_ARROW = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64()), ("t", pa.float64()), ("n", pa.int64()),
                    ("lo", pa.float64()), ("hi", pa.float64())])


@dataclass(frozen=True)
class Moments:
    """By column: number of values, mean, extremes. By pair: number of rows with both values, and the sum of the products of
    the differences from the two means over these rows. A column without a value has NaN."""

    columns: list[str]
    count: np.ndarray
    mean: np.ndarray
    low: np.ndarray
    high: np.ndarray
    both: np.ndarray
    centred: np.ndarray
    rows: int

    @property
    def complete(self) -> bool:
        return bool((self.both == self.rows).all())

    def covariance(self) -> np.ndarray:
        """With the n-1 denominator."""
        return self.centred / np.maximum(self.rows - 1, 1)

    def raw(self) -> np.ndarray:
        """Sums of the products themselves, of complete columns."""
        return self.centred + self.rows * np.outer(self.mean, self.mean)


def moments(df: DataFrame, columns: list[str], shift: list[float] | None = None) -> Moments:
    """One pass over ``columns``; without a shift, the means of the columns are taken in a pass before. NaN and infinities are missing."""
    p = len(columns)
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    if shift is None:
        finite = [F.avg(F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}"))) for i in range(p)]
        shift = [v if v is not None and abs(v) < float("inf") else 0.0 for v in values.agg(*finite).first()]
    base = np.array(shift, float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, t, n = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p), np.int64)
        low, high, rows = np.full(p, np.inf), np.full(p, -np.inf), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            met = np.isfinite(x)
            d = np.where(met, x - base, 0.0)
            m = met.astype(float)
            s, t, n = s + d.T @ d, t + d.T @ m, n + np.rint(m.T @ m).astype(np.int64)
            low, high = np.minimum(low, np.where(met, x, np.inf).min(0)), np.maximum(high, np.where(met, x, -np.inf).max(0))
            rows += batch.num_rows
        if rows:
            i, j = (a.ravel().astype(np.int32) for a in np.indices((p, p)))
            ends = [np.where(i == j, v[i], w) for v, w in ((low, np.inf), (high, -np.inf))]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i, j, s.ravel(), t.ravel(), n.ravel(), *ends)], schema=_ARROW)
            # One more row for the number of rows, complete or not.
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((-1, -1, 0.0, 0.0, rows, np.inf, -np.inf), _ARROW)], schema=_ARROW)

    parts = values.mapInArrow(sums, _DDL).groupBy("i", "j").agg(F.sum("s"), F.sum("t"), F.sum("n"), F.min("lo"), F.max("hi"))
    s, t, n = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p), np.int64)
    low, high, rows = np.full(p, np.nan), np.full(p, np.nan), 0
    for i, j, a, b, c, lo, hi in parts.collect():  # p * p + 1 rows
        if i < 0:
            rows = c
            continue
        s[i, j], t[i, j], n[i, j] = a, b, c
        if i == j and c:
            low[i], high[i] = lo, hi
    count = n.diagonal().copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        off = np.where(count > 0, t.diagonal() / count, np.nan)  # the mean less the shift
    # t[i, j]: sum of column i's differences over the rows where j has a value, too.
    centred = s - off[:, None] * t.T - off[None, :] * t + n * np.outer(off, off)
    return Moments(list(columns), count, base + off, low, high, n, centred, rows)
