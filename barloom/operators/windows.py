"""Ordered window operators over a ``Series``: shifts, trailing moments, ewm, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.blocks import Series, broadcast_up_to

# Rows per stretch of the ewm scan. Both decays in use are below 1e-29 after one
# stretch, so relative to a present value, which has weight 1, the stretch before the
# last cannot be seen in a double.
STRETCH = 1024

# pandas' results for a window of equal values, and the variance
# at or below which it reports no skewness or kurtosis.
FLAT_SKEW = 0.0
FLAT_KURT = -3.0
MIN_VARIANCE = 1e-14


def span_decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def halflife_decay(halflife: float) -> float:
    return 0.5 ** (1.0 / halflife)


# -- fixed look-backs ---------------------------------------------------------------


def lags(s: Series, wanted: dict[str, list[int]], window=None) -> Series:
    """Add ``lag_name(c, k)`` for each column c and offset k; all share one window."""
    w = s.window() if window is None else window
    new = [F.expr(f"lag({c}, {k})").over(w).alias(lag_name(c, k)) for c, ks in wanted.items() for k in ks]
    return s.with_df(s.df.select("*", *new))


def lag_name(column: str, k: int) -> str:
    return f"_{column}_lag{k}"


class Trailing:
    """SQL for statistics of the current and the n-1 previous values, from their lag columns.

    ``sums`` are power sums of the differences from the newest value; projected
    first, they make every statistic a short expression over columns. One of the
    differences is 0, so the central moments lose no more than a factor n to
    cancellation, and equal values give exactly 0. A missing value, or a row
    that does not exist, makes each sum NULL: n values are needed, as in pandas.
    """

    def __init__(self, column: str, n: int = 5, powers: int = 1):
        self.column, self.n, self.powers = column, n, powers

    def _sum_name(self, p: int) -> str:
        return f"_{self.column}_sum{p}"

    def sums(self) -> list[Column]:
        steps = [f"({lag_name(self.column, k)} - {self.column})" for k in range(1, self.n)]
        return [
            F.expr(" + ".join("*".join([d] * p) for d in steps)).alias(self._sum_name(p))
            for p in range(1, self.powers + 1)
        ]

    def _expr(self, template: str) -> str:
        """Fill in a SQL template: x newest value, n count, u mean offset, s2..s4 raw moments."""
        n = f"{float(self.n)}D"
        names = {"x": self.column, "n": n, "u": f"({self._sum_name(1)} / {n})"}
        names |= {f"s{p}": f"({self._sum_name(p)} / {n})" for p in range(2, self.powers + 1)}
        if self.powers >= 2:
            names["m2"] = "({s2} - {u}*{u})".format(**names)
        if self.powers >= 4:
            names["m3"] = "({s3} - 3*{u}*{s2} + 2*{u}*{u}*{u})".format(**names)
            names["m4"] = "({s4} - 4*{u}*{s3} + 6*{u}*{u}*{s2} - 3*{u}*{u}*{u}*{u})".format(**names)
        return template.format(**names)

    def _extreme(self, function: str) -> str:
        values = ", ".join([self.column, *(lag_name(self.column, k) for k in range(1, self.n))])
        return f"if({self._sum_name(1)} is not null, {function}({values}), null)"

    def mean(self) -> str:
        return self._expr("{x} + {u}")

    def std(self) -> str:
        return self._expr("sqrt(if({m2} < 0, 0D, {m2}) * ({n} / ({n} - 1)))")

    def max(self) -> str:
        return self._extreme("greatest")

    def min(self) -> str:
        return self._extreme("least")

    def skew(self) -> str:
        return self._expr(
            f"case when {{s2}} = 0 then {FLAT_SKEW}D when {{m2}} > {MIN_VARIANCE} "
            "then {m3} / ({m2} * sqrt({m2})) * (sqrt({n} * ({n} - 1)) / ({n} - 2)) end"
        )

    def kurt(self) -> str:
        return self._expr(
            f"case when {{s2}} = 0 then {FLAT_KURT}D when {{m2}} > {MIN_VARIANCE} "
            "then (({m4} / ({m2} * {m2}) - 3) * ({n} + 1) + 6) * (({n} - 1) / (({n} - 2) * ({n} - 3))) end"
        )


# -- exponentially weighted means ---------------------------------------------------


def index_rows(s: Series) -> Series:
    """Add _i (row index in the series or block), its stretch _sub and place _k in it.

    In a block, copied rows come first and are not counted.
    """
    w = s.window()
    i = F.row_number().over(w) - 1
    if s.blocked:
        i = i - F.sum(F.when(F.col("_own"), 0).otherwise(1)).over(w)
    df = s.df.select("*", i.cast("bigint").alias("_i"))
    return s.with_df(df.selectExpr("*", f"floor(_i / {STRETCH}) as _sub", f"pmod(_i, {STRETCH}) as _k"))


def stretch_window(s: Series):
    """Series order that starts with _sub: the same order, and the one ewm sorts by."""
    return Window.partitionBy(*s.keys).orderBy("_sub", "date", "interval")


def ewm(s: Series, specs: dict[str, tuple[str, float]], sums_too: bool = False) -> Series:
    """Exponentially weighted means ``{out: (column, decay)}`` of an indexed series.

    The value at row t is sum(d^(t-i) x_i) / sum(d^(t-i)) over the present x_i
    up to t; the age counts missing rows too, and a missing row repeats the last
    value. A running sum of x_i d^-i overflows, so it restarts at each stretch;
    the stretch before enters through its state at its last row. ``sums_too``
    adds both sums as of each row, n_<out> and d_<out>.
    """
    if not specs:
        return s
    inner = Window.partitionBy(*s.keys, "_sub").orderBy("date", "interval").rowsBetween(Window.unboundedPreceding, 0)
    so_far = stretch_window(s).rowsBetween(Window.unboundedPreceding, 0)
    before = stretch_window(s).rowsBetween(Window.unboundedPreceding, -1)
    names = {d: j for j, d in enumerate(sorted({d for _, d in specs.values()}))}
    keep = s.df.columns
    # Columns: _n_ weighted sum, _d_ sum of weights, _cn_/_cd_ the same at the end of the
    # stretch before, _in._ the same (and the mean, e) at the end of the block before.
    parts = [(p, out, d, f"_down{names[d]}") for out, (_, d) in specs.items() for p in "nd"]

    df = s.df.selectExpr(
        "*",
        *[f"pow({1.0 / d!r}D, _k) as _up{j}" for d, j in names.items()],
        *[f"pow({d!r}D, _k) as _down{j}" for d, j in names.items()],
    )
    sums = []
    for out, (c, d) in specs.items():
        live = f"{c} is not null" + (" and _own" if s.blocked else "")
        up = f"_up{names[d]}"
        sums += [
            F.expr(f"sum(if({live}, {c} * {up}, 0D))").over(inner).alias(f"_n_{out}"),
            F.expr(f"sum(if({live}, {up}, 0D))").over(inner).alias(f"_d_{out}"),
        ]
    df = df.select("*", *sums)
    downs = [f"_down{j}" for j in names.values()]
    df = df.selectExpr(*keep, *downs, *[f"_{p}_{out} * {down} as _{p}_{out}" for p, out, _, down in parts])
    df = df.select("*", *[
        F.expr(f"last(if(_k = {STRETCH - 1}, _{p}_{out}, null), true)").over(before).alias(f"_c{p}_{out}")
        for p, out, _, _ in parts
    ])
    df = df.selectExpr(*keep, *[
        f"_{p}_{out} + coalesce(_c{p}_{out}, 0D) * {down} * {d!r}D as _{p}_{out}" for p, out, d, down in parts
    ])
    arrived = []
    if s.blocked:
        arrived = [f"_ine_{out}" for out in specs]
        carry = broadcast_up_to(_ewm_carry(s, specs), s.blocks)
        df = df.join(carry, s.keys, "left").selectExpr(*keep, *arrived, *[
            f"_{p}_{out} + coalesce(_in{p}_{out}, 0D) * pow({d!r}D, _i + 1) as _{p}_{out}" for p, out, d, _ in parts
        ])
    # Only a present row gets a value of its own: its weight is 1, so what was dropped cannot be
    # seen in it. Across a gap the last one is repeated; there the sums have faded away.
    live = " and _own" if s.blocked else ""
    totals = [f"_{p}_{out} as {p}_{out}" for p, out, _, _ in parts] if sums_too else []
    df = df.selectExpr(*keep, *arrived, *totals, *[
        f"if({c} is not null{live}, try_divide(_n_{out}, _d_{out}), null) as _e_{out}" for out, (c, _) in specs.items()
    ])
    df = df.select("*", *[F.expr(f"last(_e_{out}, true)").over(so_far).alias(f"_l_{out}") for out in specs])
    return s.with_df(df.selectExpr(*keep, *[f"{p}_{out}" for p, out, _, _ in parts if sums_too], *[
        (f"coalesce(_l_{out}, _ine_{out})" if s.blocked else f"_l_{out}") + f" as {out}" for out in specs
    ]))


def _ewm_carry(s: Series, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """Incoming (n, d, e) of each block, from one summary row per block.

    The summary holds the weighted sums as of the last present value of the
    block; only the STRETCH rows up to it can be seen in them, since that value has weight 1. A symbol has
    rows / max_rows summaries, so the fold over them is short however long the
    series is. A series that goes on from a state starts with that.
    """
    start = None
    if s.state is not None:
        start = s.state.select("symbol", F.lit(0).cast("bigint").alias("_blk"), *[F.col(f"{p}_{out}").alias(f"_in{p}_{out}") for out in specs for p in "nde"])
    if s.big is None:
        return start
    whole = Window.partitionBy(*s.keys)
    columns = sorted({c for c, _ in specs.values()})
    marked = s.cut().select(
        *s.keys, "_i", *columns, *[F.expr(f"max(if({c} is not null, _i, null))").over(whole).alias(f"_at_{c}") for c in columns]
    )
    sums = []
    for out, (c, d) in specs.items():
        seen = f"{c} is not null and _at_{c} - _i < {STRETCH}"
        sums += [
            F.expr(f"sum(if({seen}, {c} * pow({d!r}D, _at_{c} - _i), 0D)) as n_{out}"),
            F.expr(f"sum(if({seen}, pow({d!r}D, _at_{c} - _i), 0D)) as d_{out}"),
            F.expr(f"max(_at_{c}) as i_{out}"),
        ]
    flat = marked.groupBy(*s.keys).agg((F.max("_i") + 1).alias("rows"), *sums)
    cut = _fold_blocks(flat, specs, s.state)
    return cut if s.state is None else cut.unionByName(start.join(broadcast_up_to(s.big, s.blocks), "symbol", "left_anti"))


def _fold_blocks(flat: DataFrame, specs: dict[str, tuple[str, float]], state: DataFrame | None) -> DataFrame:
    """The state before each block: a fold over the ordered summaries of a symbol, from ``state`` or from nothing."""
    row = F.struct("_blk", "rows", *[F.col(f"{p}_{out}") for out in specs for p in "ndi"])
    blocks = flat.groupBy("symbol").agg(F.sort_array(F.collect_list(row)).alias("_b"))
    if state is not None:
        blocks = blocks.join(state.select("symbol", *[F.col(f"{p}_{out}").alias(f"_0{p}_{out}") for out in specs for p in "nde"]), "symbol", "left")

    def first(out: str) -> str:
        n, d, e = (f"_0{p}_{out}" for p in "nde") if state is not None else ("null", "null", "null")
        return f"coalesce(cast({n} as double), 0D) as n, coalesce(cast({d} as double), 0D) as d, cast({e} as double) as e"

    def past(out: str, d: float) -> str:
        def upto(a: str) -> str:  # as of the last row of the block
            return f"if(b.i_{out} is null, 0D, b.{a}_{out} * pow({d!r}D, b.rows - 1 - b.i_{out})) + s.{a} * pow({d!r}D, b.rows)"

        def seen(a: str) -> str:  # as of its last present value
            return f"b.{a}_{out} + s.{a} * pow({d!r}D, b.i_{out} + 1)"

        return f"""aggregate(_b,
            struct(cast(array() as array<struct<n: double, d: double, e: double>>) as past, {first(out)}),
            (s, b) -> struct(
                concat(s.past, array(struct(s.n as n, s.d as d, s.e as e))) as past, {upto('n')} as n, {upto('d')} as d,
                if(b.i_{out} is null, s.e, try_divide({seen('n')}, {seen('d')})) as e),
            s -> s.past) as _p_{out}"""

    folded = blocks.selectExpr("symbol", "transform(_b, b -> b._blk) as _blks", *[past(out, d) for out, (_, d) in specs.items()])
    each = folded.selectExpr("symbol", "explode(arrays_zip(_blks, " + ", ".join(f"_p_{out}" for out in specs) + ")) as _x")
    return each.selectExpr("symbol", "_x._blks as _blk", *[f"_x._p_{out}.{p} as _in{p}_{out}" for out in specs for p in "nde"])


# -- fills --------------------------------------------------------------------------


def ffill(s: Series, columns: list[str]) -> Series:
    """Replace missing values by the last present one before them."""
    so_far = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _fill(s, columns, so_far, F.max_by, F.asc("_blk"))


def bfill(s: Series, columns: list[str]) -> Series:
    """Replace missing values by the next present one after them.

    Runs over the descending order: a frame to the end of the partition would
    be evaluated anew for every row.
    """
    back = Window.partitionBy(*s.keys).orderBy(F.desc("date"), F.desc("interval"))
    so_far = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _fill(s, columns, so_far, F.min_by, F.desc("_blk"))


def fill_both(s: Series, columns: list[str]) -> Series:
    """ffill, then bfill. What ffill leaves open is a leading gap, and the value
    that closes it is the series' first present one: no second order is needed."""
    if s.blocked:
        return bfill(ffill(s, columns), columns)
    w = s.window()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = [c for c in s.df.columns if c not in columns]
    df = s.df.select(
        "*",
        *[F.last(c, ignorenulls=True).over(so_far).alias(f"_f_{c}") for c in columns],
        *[F.first(c, ignorenulls=True).over(whole).alias(f"_b_{c}") for c in columns],
    )
    return s.with_df(df.select(*rest, *[F.coalesce(f"_f_{c}", f"_b_{c}").alias(c) for c in columns]).select(*s.df.columns))


def _fill(s: Series, columns, so_far, edge, block_order) -> Series:
    rest = [c for c in s.df.columns if c not in columns]
    if not s.blocked:
        filled = [F.last(c, ignorenulls=True).over(so_far).alias(c) for c in columns]
        return s.with_df(s.df.select(*rest, *filled).select(*s.df.columns))
    # One row per block with its outermost present values, then the nearest of them
    # on the far side of the block.
    place = F.struct("date", "interval")
    ends = s.cut().groupBy(*s.keys).agg(
        *[edge(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns]
    )
    across = Window.partitionBy("symbol").orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*s.keys, *[F.last(c, ignorenulls=True).over(across).alias(f"_in_{c}") for c in columns])
    df = s.df.select("*", *[F.last(c, ignorenulls=True).over(so_far).alias(f"_f_{c}") for c in columns])
    df = df.join(broadcast_up_to(ends, s.blocks), s.keys, "left")
    return s.with_df(df.select(*rest, *[F.coalesce(f"_f_{c}", f"_in_{c}").alias(c) for c in columns]).select(*s.df.columns))
