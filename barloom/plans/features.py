"""The 62-feature plan and the 6-feature baseline, one DataFrame in and one out.

Shape for a table whose symbols fit a task: one exchange on ``symbol`` and
three sorts of narrow rows.

1. (symbol; date, interval): row index, the 12-bar lag and from it ``bret12``;
2. (symbol, interval): the mean of ``bret12``, served by the same exchange;
3. (symbol, stretch; date, interval): ewm scan and the remaining lags.

Everything else is row arithmetic in the closing projection. Asking for a
subset of the names lets Catalyst drop the scans, lags and sorts the others
need. Symbols too big for a task are cut into blocks first (``operators.blocks``);
the mean then comes from a narrow pass of its own and is joined to the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.columns import clean, imbalance, log1p0, ratio, zero
from barloom.operators.blocks import MAX_ROWS, Layout, Series, broadcast_up_to, find_layout, place
from barloom.operators.windows import (
    Trailing, ewm, halflife_decay, index_rows, lag_name, lags, span_decay, stretch_window,
)
from barloom.session import prefer_compiled_projections
from barloom.sources.schema import BAR_COLUMNS, KEY, LABEL, require_columns

# The emitted feature names, in emission order.
FEATURE_NAMES = (
    "ob_imb0",
    "ob_imb4",
    "ob_imb9",
    "trade_imb",
    "trade_imbema5",
    "lagret12",
    "trend_midpx",
    "trend_high",
    "trend_low",
    "trend_open",
    "trend_lastpx",
    "trend_tradeBuyQty",
    "trend_tradeSellQty",
    "diff_high_low",
    "diff_midpx_open",
    "diff_lastpx_midpx",
    "ratio_high_low",
    "ratio_open_close",
    "ratio_midpx_open",
    "ratio_tradeBuyQty_tradeSellQty",
    "log_midpx",
    "log_high",
    "log_lastpx",
    "log_tradeBuyQty",
    "log_tradeSellQty",
    "moving_avg_open_5",
    "moving_avg_lastpx_5",
    "rolling_std_midpx_5",
    "rolling_skew_midpx_5",
    "rolling_kurt_midpx_5",
    "max_midpx_last_N",
    "mean_midpx_last_N",
    "product_midpx_tradeBuyQty",
    "ratio_bid_ask",
    "ema_trade_imb",
    "cxlSellHigh",
    "cxlSellTurnover",
    "cxlSellQty",
    "ratio_high_bid0",
    "ratio_ask0_open",
    "spread_bid_ask",
    "spread_high_low",
    "volatility_high_low",
    "momentum_midpx",
    "momentum_trade_imb",
    "log_ask0",
    "log_bid0",
    "volatility_log_midpx",
    "momentum_log_midpx",
    "ratio_high_ask0",
    "ratio_low_bid0",
    "diff_bid0_ask0",
    "ratio_lastpx_bid0",
    "moving_avg_tradeBuyQty_5",
    "moving_avg_tradeSellQty_5",
    "rolling_mean_tradeBuyQty_5",
    "rolling_mean_tradeSellQty_5",
    "ema_midpx",
    "ema_high",
    "ema_low",
    "ema_open",
    "ema_lastpx",
)

# Computed on request, not emitted by default.
INTERMEDIATE_NAMES = (
    "bret12",
    "cx_bret12",
    "log_ob_imb0",
    "log_ob_imb4",
    "log_trade_imbema5",
    "log_lagret12",
    "diff_open_close",
    "ratio_lastpx_midpx",
    "log_low",
    "log_open",
    "moving_avg_midpx_5",
    "moving_avg_high_5",
    "moving_avg_low_5",
    "volatility_midpx_5",
    "rolling_mean_midpx_5",
    "min_midpx_last_N",
)

BASELINE_NAMES = FEATURE_NAMES[:6]

# Look-backs and smoothing constants.
RETURN_LAG = 12
MOMENTUM_LAG = 5
TRAIL = 5
IMBALANCE_HALFLIFE = 5
EMA_SPAN = 30

FIND = "find"

PRICES = ("midpx", "high", "low", "open", "lastpx")
QUANTITIES = ("tradeBuyQty", "tradeSellQty")
# Columns with trailing statistics, and the highest moment each needs.
TRAILED = {"midpx": 4, "high": 2, "low": 2, "open": 1, "lastpx": 1, "tradeBuyQty": 1, "tradeSellQty": 1, "log_midpx": 2}
BOOK_LEVELS = {"ob_imb0": ("asize0", "bsize0"), "ob_imb4": ("asize0_4", "bsize0_4"), "ob_imb9": ("asize5_9", "bsize5_9")}


def feature_names() -> list[str]:
    return list(FEATURE_NAMES)


def features(
    bars: DataFrame,
    names: list[str] | None = None,
    mean_scope: str = "symbol",
    label_null: str = "zero",
    max_rows: int | None = MAX_ROWS,
    state=None,
    layout: Layout | None | str = FIND,
) -> DataFrame:
    """Key columns, the named features (default: all 62, in order) and the label.

    ``state``: the ``RangeState`` of the bars before these; without one, windows start empty.
    ``layout``: a layout found before, None if every symbol fits a task; by default symbols are counted first.

    ``mean_scope`` says which rows share the mean return that ``lagret12`` is
    measured against: those of the same ``symbol`` and interval, or the whole
    ``universe`` at that interval. A missing label becomes 0 (``zero``) or its
    row is left out (``drop``). No NULL, NaN or infinity remains.
    """
    names = list(FEATURE_NAMES if names is None else names)
    unknown = set(names) - set(FEATURE_NAMES) - set(INTERMEDIATE_NAMES)
    if unknown:
        raise ValueError(f"unknown features {sorted(unknown)}")
    if mean_scope not in ("symbol", "universe"):
        raise ValueError(f"mean_scope must be 'symbol' or 'universe', got {mean_scope!r}")

    if state is not None and state.mean_scope != mean_scope:
        raise ValueError(f"the state holds means of scope {state.mean_scope!r}")
    with_mean = any("lagret12" in n or "cx_" in n for n in names)
    s = _prepare(bars, label_null, mean_scope, True, max_rows, with_mean, state, layout)
    s = s.with_df(s.df.selectExpr("*", f"{imbalance(*QUANTITIES)} as trade_imb", f"{log1p0('midpx')} as log_midpx"))

    s = ewm(s, {out: spec for out, spec in weighted_means().items() if any(out in n for n in names)})
    trail = list(range(1, TRAIL))
    s = lags(
        s,
        {c: trail + ([MOMENTUM_LAG] if c == "midpx" else []) for c in TRAILED}
        | {"trade_imb": [MOMENTUM_LAG]},
        stretch_window(s),
    )
    df = _originals(s)
    trails = {c: Trailing(c, TRAIL, p) for c, p in TRAILED.items()}
    # Two projections: the power sums are used several times each, so Catalyst keeps them apart.
    df = df.select("*", F.expr("bret12 - cx_bret12 as lagret12"), *[x for t in trails.values() for x in t.sums()])
    catalogue = _catalogue(trails)
    return _emit(df, {n: catalogue[n] for n in names})


def weighted_means() -> dict[str, tuple[str, float]]:
    """The exponentially weighted means: {name: (column, decay)}."""
    decay = span_decay(EMA_SPAN)
    return {
        "trade_imbema5": ("trade_imb", halflife_decay(IMBALANCE_HALFLIFE)),
        "ema_trade_imb": ("trade_imb", decay),
        **{f"ema_{c}": (c, decay) for c in PRICES},
    }


def baseline_features(bars: DataFrame, label_null: str = "zero", max_rows: int | None = MAX_ROWS) -> DataFrame:
    """The six-feature set: plain denominators, mean return over all symbols.

    Windows stay within a symbol.
    """
    s = _prepare(bars, label_null, "universe", False, max_rows)
    s = s.with_df(s.df.selectExpr("*", f"{imbalance(*QUANTITIES, guard=False)} as trade_imb"))
    s = ewm(s, {"trade_imbema5": ("trade_imb", halflife_decay(IMBALANCE_HALFLIFE))})
    df = _originals(s)
    values = {n: imbalance(*sizes, guard=False) for n, sizes in BOOK_LEVELS.items()}
    values |= {"lagret12": "bret12 - cx_bret12"}
    return _emit(df, {n: values.get(n, n) for n in BASELINE_NAMES})


# -- stages -------------------------------------------------------------------------


def clean_rows(bars: DataFrame) -> DataFrame:
    """Key, numeric columns and label, with one form of missing data."""
    require_columns(bars, (*KEY, *BAR_COLUMNS))
    columns = [*BAR_COLUMNS, *([LABEL] if LABEL in bars.columns else [])]
    return clean(bars.selectExpr(*KEY, *[f"cast({c} as double) as {c}" for c in columns]), columns)


def given_rows(raw: DataFrame, state) -> DataFrame:
    """The rows and, with a state, its bars before them; ``_given`` tells them apart."""
    if state is None:
        return raw
    before = state.series.select("symbol", F.inline("bars"), F.lit(False).alias("_given"))
    return raw.withColumn("_given", F.lit(True)).unionByName(before, allowMissingColumns=True)


def placed(raw: DataFrame, layout: Layout | None, state) -> Series:
    return place(raw, layout) if state is None else place(raw, layout, state.series, state.series.count())


def _prepare(bars: DataFrame, label_null: str, scope: str, guard: bool, max_rows: int | None, with_mean: bool = True, state=None,
             layout: Layout | None | str = FIND) -> Series:
    """Cleaned, indexed series with ``bret12`` and ``cx_bret12``."""
    if label_null not in ("zero", "drop"):
        raise ValueError(f"label_null must be 'zero' or 'drop', got {label_null!r}")
    raw = clean_rows(bars)
    prefer_compiled_projections(bars.sparkSession)
    if LABEL in raw.columns and label_null == "drop":
        # The rows still feed the windows; they go together with the copies.
        raw = raw.selectExpr("*", f"{LABEL} is not null as _keep")
    raw = given_rows(raw, state)
    groups = None
    if layout == FIND and with_mean and scope == "universe":
        most, groups = _sizes(raw, state)
        layout = find_layout(raw, before=RETURN_LAG, max_rows=max_rows) if max_rows is not None and most > max_rows else None
    if layout == FIND:
        layout = find_layout(raw, before=RETURN_LAG, max_rows=max_rows)
    windowed = scope == "symbol" and layout is None and state is None
    if with_mean and not windowed:
        raw = _join_mean(raw, layout, scope, guard, state, groups)
    # The lag and the row index are in one window.
    s = _back_return(index_rows(lags(placed(raw, layout, state), {"midpx": [RETURN_LAG]})), guard)
    if windowed:
        # The exchange on symbol already serves this window.
        group = Window.partitionBy("symbol", "interval")
        return s.with_df(s.df.withColumn("cx_bret12", F.avg("bret12").over(group)))
    return s if with_mean else s.with_df(s.df.selectExpr("*", "cast(null as double) as cx_bret12"))


def _back_return(s: Series, guard: bool) -> Series:
    past = lag_name("midpx", RETURN_LAG)
    change = f"(midpx - {past})"
    value = ratio(change, past) if guard else f"try_divide({change}, {past})"
    return s.with_df(s.df.selectExpr("*", f"{value} as bret12"))


def mean_sums(raw: DataFrame, layout: Layout | None, scope: str, guard: bool, state=None) -> DataFrame:
    """Total and number of the returns of each group, those of the state included; from the key and ``midpx`` alone."""
    on = ["interval"] if scope == "universe" else ["symbol", "interval"]
    narrow = raw.select(*KEY, "midpx", *([] if state is None else ["_given"]))
    s = _back_return(lags(placed(narrow, layout, state), {"midpx": [RETURN_LAG]}), guard)
    sums = s.own().groupBy(*on).agg(F.sum("bret12").alias("total"), F.count("bret12").alias("rows"))
    if state is None:
        return sums
    return sums.unionByName(state.means).groupBy(*on).agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))


def _sizes(raw: DataFrame, state) -> tuple[int, int]:
    """Rows of the largest symbol and number of intervals, counted side by side in one read."""
    sets = raw.groupingSets([["symbol"], ["interval"]], "symbol", "interval").agg(F.count("*").alias("n"), F.grouping("symbol").alias("by_interval"))
    largest = F.max(F.when((F.col("by_interval") == 0) & F.col("symbol").isNotNull(), F.col("n")))
    most, n = sets.agg(largest, F.count_if(F.col("by_interval") == 1)).first()
    return most or 0, n + (0 if state is None else state.means.count())


def _join_mean(raw: DataFrame, layout: Layout | None, scope: str, guard: bool, state=None, groups: int | None = None) -> DataFrame:
    """Join ``cx_bret12`` to the raw rows, from a pass over the key and ``midpx`` alone.

    Sum and count are combined map-side. The means are broadcast if the number of
    groups, counted first, allows it. If not, it is the raw rows that are shuffled
    for the join and not the three times wider features; AQE splits a hot group.
    """
    on = ["interval"] if scope == "universe" else ["symbol", "interval"]
    if groups is None:
        groups = raw.select(*on).distinct().count() + (0 if state is None else state.means.count())
    means = mean_sums(raw, layout, scope, guard, state).selectExpr(*on, "try_divide(total, rows) as cx_bret12")
    return raw.join(broadcast_up_to(means, groups), on, "left").select(*raw.columns, "cx_bret12")


def _originals(s: Series) -> DataFrame:
    """The rows to emit: no copies, and none that lacks a label if those are unwanted."""
    df = s.own()
    return df.where("_keep") if "_keep" in df.columns else df


def _emit(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Key, values and label; the 0-fill is its own projection, as it names each value twice."""
    label = [LABEL] if LABEL in df.columns else []
    df = df.selectExpr(*KEY, *[f"{e} as {n}" for n, e in values.items()], *label)
    return df.selectExpr(*KEY, *[f"{zero(n)} as {n}" for n in (*values, *label)])


def _catalogue(trail: dict[str, Trailing]) -> dict[str, str]:
    """Every feature as SQL over the staged frame."""

    def gap(a: str, b: str) -> str:
        return f"{a} - {b}"

    def change(c: str, k: int = 1) -> str:
        return gap(c, lag_name(c, k))

    mid = trail["midpx"]
    staged = ("trade_imb", "trade_imbema5", "lagret12", "log_midpx", "bret12", "cx_bret12", "ema_trade_imb",
              "cxlSellHigh", "cxlSellTurnover", "cxlSellQty", *[f"ema_{c}" for c in PRICES])
    return {
        **{n: n for n in staged},
        **{n: imbalance(*sizes) for n, sizes in BOOK_LEVELS.items()},
        **{f"trend_{c}": change(c) for c in (*PRICES, *QUANTITIES)},
        "momentum_midpx": change("midpx", MOMENTUM_LAG),
        "momentum_trade_imb": change("trade_imb", MOMENTUM_LAG),
        "momentum_log_midpx": change("log_midpx"),
        # differences and spreads
        "diff_high_low": gap("high", "low"),
        "spread_high_low": gap("high", "low"),
        "diff_open_close": gap("open", "lastpx"),
        "diff_midpx_open": gap("midpx", "open"),
        "diff_lastpx_midpx": gap("lastpx", "midpx"),
        "diff_bid0_ask0": gap("bid0", "ask0"),
        "spread_bid_ask": gap("ask0", "bid0"),
        # ratios
        **{f"ratio_{a}_{b}": ratio(a, b) for a, b in (
            ("high", "low"), ("midpx", "open"), ("lastpx", "midpx"), ("tradeBuyQty", "tradeSellQty"),
            ("high", "bid0"), ("ask0", "open"), ("lastpx", "bid0"), ("high", "ask0"), ("low", "bid0"))},
        "ratio_open_close": ratio("open", "lastpx"),
        "ratio_bid_ask": ratio("bid0", "ask0"),
        "product_midpx_tradeBuyQty": "midpx * tradeBuyQty",
        # logarithms
        **{f"log_{c}": log1p0(c) for c in (
            "high", "low", "open", "lastpx", "tradeBuyQty", "tradeSellQty", "ask0", "bid0", "trade_imbema5", "lagret12")},
        **{f"log_{n}": log1p0(imbalance(*BOOK_LEVELS[n])) for n in ("ob_imb0", "ob_imb4")},
        # trailing statistics
        **{f"moving_avg_{c}_5": t.mean() for c, t in trail.items() if c != "log_midpx"},
        **{f"rolling_mean_{c}_5": trail[c].mean() for c in ("midpx", *QUANTITIES)},
        "mean_midpx_last_N": mid.mean(),
        "max_midpx_last_N": mid.max(),
        "min_midpx_last_N": mid.min(),
        "rolling_std_midpx_5": mid.std(),
        "volatility_midpx_5": mid.std(),
        "rolling_skew_midpx_5": mid.skew(),
        "rolling_kurt_midpx_5": mid.kurt(),
        "volatility_log_midpx": trail["log_midpx"].std(),
        "volatility_high_low": gap(trail["high"].std(), trail["low"].std()),
    }
