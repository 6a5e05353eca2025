"""Exact quantiles with linear interpolation, without holding a column in one place.

One KLL sketch per column brackets all its wanted order statistics in one pass. The next pass counts
the values outside each bracket exactly and, where the sketch promises few values inside, collects those and
picks the answer; where it does not, it sketches the inside, which gives a bracket some 200 times
narrower for the pass after. So columns of up to 2 million values take two passes, up to 400 million
three. Every size goes through the same steps. Brackets are open intervals, and a value at the end of one that
is itself the answer ends the search, so heavy duplicates cannot keep a bracket large.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SMALL = 20_000  # values collected for a wanted statistic
SKETCH = 4000  # the k of the sketches
MARGIN = 0.0025  # of ranks; about twice the error of a sketch
GRID = 1000


@dataclass
class _Search:
    """An order statistic (rank from 0) of a column, the bracket to try, and what is known to hold it."""

    column: str
    rank: int
    lo: float
    hi: float
    expected: float  # values inside, at most
    known: tuple[float, float, float]  # a bracket that holds it, and its number of values
    margin: float
    answer: float | None = None


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], small: int = SMALL, extra: dict[str, Column] | None = None, margin: float = MARGIN,
):
    """{column: [value per prob]}; NULLs are not counted, an all-NULL column gives None.

    With ``extra`` aggregates, which are taken along in the first pass, a pair of that and {name: value}.
    """
    extra = extra or {}
    shares = [min(1.0, max(0.0, p + s)) for p in probs for s in (-margin, margin)]
    aggs = [
        F.struct(*[F.expr(f"{f}({_number(c)})").alias(name) for name, f in (("n", "count"), ("lo", "min"), ("hi", "max"))],
                 _ranked(_number(c), shares).alias("at")).alias(f"c{i}")
        for i, c in enumerate(columns)]
    aggs += [v.alias(f"x{i}") for i, v in enumerate(extra.values())]
    row = df.agg(*aggs).first() if aggs else None
    heights: dict[str, list[float]] = {}
    searches: dict[tuple[str, int], _Search] = {}
    for i, c in enumerate(columns):
        n, low, high, at = row[f"c{i}"]
        heights[c] = [(n - 1) * p for p in probs] if n else []
        for j, h in enumerate(heights[c]):
            for rank in {math.floor(h), math.ceil(h)}:
                # Beyond the margin's reach the sketch's least and greatest value are not the column's.
                lo = low if shares[2 * j] == 0 else at[2 * j]
                hi = high if shares[2 * j + 1] == 1 else at[2 * j + 1]
                searches[c, rank] = _Search(c, rank, lo, hi, 4 * margin * n, (low, high, n), margin)
    _run(df, list(searches.values()), small)
    result: dict[str, list[float | None]] = {}
    for c in columns:
        ends = [(searches[c, math.floor(h)].answer, searches[c, math.ceil(h)].answer, h - math.floor(h)) for h in heights[c]]
        result[c] = [float(lo + (hi - lo) * part) for lo, hi, part in ends] if ends else [None] * len(probs)
    return (result, {name: row[f"x{i}"] for i, name in enumerate(extra)}) if extra else result


def _number(column: str) -> str:
    return f"cast(`{column}` as double)"


def _ranked(value: str, shares: list[float]) -> Column:
    """Values near the given ranks, from one sketch."""
    ranks = ", ".join(f"{s!r}D" for s in shares)
    return F.expr(f"if(count({value}) > 0, kll_sketch_get_quantile_double(kll_sketch_agg_double({value}, {SKETCH}), array({ranks})), null)")


def _run(df: DataFrame, left: list[_Search], small: int) -> None:
    """Answer the searches, each round in one pass."""
    while left:
        brackets = sorted({(s.column, s.lo, s.hi, s.expected <= small) for s in left})
        aggs = []
        for j, (c, lo, hi, few) in enumerate(brackets):
            v = _number(c)
            inside = f"if({v} > {lo!r}D and {v} < {hi!r}D, {v}, null)"
            aggs.append(F.struct(
                *[F.expr(f"count_if({v} {op} {end!r}D) as {name}") for name, op, end in
                  (("under_lo", "<", lo), ("upto_lo", "<=", lo), ("under_hi", "<", hi), ("upto_hi", "<=", hi))],
                (F.expr(f"sort_array(collect_list({inside}))") if few else _ranked(inside, [i / GRID for i in range(GRID + 1)])).alias("values"),
            ).alias(f"b{j}"))
        row = df.agg(*aggs).first()
        counted = {b: row[f"b{j}"] for j, b in enumerate(brackets)}
        again = []
        for s in left:
            few = s.expected <= small
            got = counted[s.column, s.lo, s.hi, few]
            if got["under_lo"] <= s.rank < got["upto_lo"]:
                s.answer = s.lo
            elif got["under_hi"] <= s.rank < got["upto_hi"]:
                s.answer = s.hi
            elif not got["upto_lo"] <= s.rank < got["under_hi"]:  # the sketch missed: a new one of what holds it, and a wider look
                s.lo, s.hi, s.expected = s.known
                s.margin *= 4
                again.append(s)
            elif few:
                s.answer = float(got["values"][s.rank - got["upto_lo"]])
            else:
                n = got["under_hi"] - got["upto_lo"]
                s.known = s.lo, s.hi, n
                share = (s.rank - got["upto_lo"] + 0.5) / n
                below, above = math.floor((share - s.margin) * GRID), math.ceil((share + s.margin) * GRID)
                values = got["values"]
                # At the ends of the grid the bracket's own end stays.
                s.lo, s.hi = (values[below] if below > 0 else s.lo), (values[above] if above < GRID else s.hi)
                s.expected = min(n, 4 * s.margin * n + 2 * n / GRID)
                again.append(s)
        left = again
