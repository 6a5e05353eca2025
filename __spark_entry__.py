"""

Every query reads the given tables whole. ``events`` are turned into hourly
bars first (``barloom.sources.events``), ``orders`` give the trading calendar
and ``lineitem`` the dates looked up in it.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.operators.calendar import TradingCalendar  # noqa: E402
from barloom.operators.prepare import (  # noqa: E402
    clean_bars, fill_mean, fit_components, price_series, scaled_bars, volume_series,
)
from barloom.operators.blocks import series  # noqa: E402
from barloom.operators.windows import bfill, ewm, ffill, halflife_decay, index_rows, span_decay  # noqa: E402
from barloom.operators.profile import box_stats, describe, histogram, info, missing_check  # noqa: E402
from barloom.plans.elimination import eliminate  # noqa: E402
from barloom.plans.engine import Engine  # noqa: E402
from barloom.plans.features import (  # noqa: E402
    BASELINE_NAMES, FEATURE_NAMES, INTERMEDIATE_NAMES, baseline_features, features,
)
from barloom.plans.metrics import metrics  # noqa: E402
from barloom.plans.models import BoostedTrees, Ridge, Tree, split_importance  # noqa: E402
from barloom.session import ensure_checkpoint_dir  # noqa: E402
from barloom.sources.bars import bars_between, bars_of_symbol, bars_on  # noqa: E402
from barloom.sources.events import labelled_bars  # noqa: E402
from barloom.sources.schema import BAR_COLUMNS, KEY, LABEL  # noqa: E402
from oracle.rounding import digits  # noqa: E402
from oracle.sql import all_sql  # noqa: E402

try:  # the training-data operators and their pipeline can be left out
    import corpus_pipeline  # noqa: E402
    from barloom.llm import queries as training  # noqa: E402
except ImportError:
    corpus_pipeline = training = None

Query = Callable[[SparkSession, str], DataFrame]

VALUES = [*BAR_COLUMNS, LABEL]
INFINITE_FEATURES = ["trend_high", "diff_high_low", "ratio_high_low", "ratio_open_close", "log_low", "ema_high", "ema_low", "moving_avg_open_5", "volatility_high_low"]
TRAIN, TEST = (20240101, 20240120), (20240121, 20240131)


def _starting(*prefixes: str) -> list[str]:
    return [n for n in FEATURE_NAMES if n.startswith(prefixes)]


FAMILIES = {
    "feat_imbalance": _starting("ob_imb") + ["trade_imb"],
    "feat_trend": _starting("trend_"),
    "feat_diff_spread": _starting("diff_", "spread_"),
    "feat_ratio": _starting("ratio_"),
    "feat_log": _starting("log_"),
    "feat_product_cancel": _starting("product_", "cxl"),
    "feat_rolling_mean": _starting("moving_avg_", "rolling_mean_", "mean_"),
    "feat_rolling_std": _starting("rolling_std_", "volatility_"),
    "feat_rolling_extrema": ["max_midpx_last_N", "min_midpx_last_N"],
    "feat_rolling_moments": _starting("rolling_skew_", "rolling_kurt_"),
    "feat_momentum": _starting("momentum_"),
    "feat_ewm_halflife": ["trade_imbema5"],
    "feat_ewm_span": _starting("ema_"),
    "feat_lagret_symbol": ["lagret12"],
}


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_bars(spark.read.parquet(f"{sf}/events.parquet"))


def _rounded(df: DataFrame, fixed: int | None = None) -> DataFrame:
    """Round computed doubles to the digits they are compared at."""
    keep = (*KEY, LABEL) if fixed is None else KEY

    def shown(name: str, dtype: str):
        d = fixed if fixed is not None else digits(name)
        return F.round(name, d).alias(name) if dtype == "double" and name not in keep and d is not None else F.col(name)

    return df.select(*[shown(n, t) for n, t in df.dtypes])


def _features(names, **options) -> Query:
    return lambda spark, sf: _rounded(features(_bars(spark, sf), list(names), **options))


def _day(column: str):
    return (F.year(column) * 10000 + F.month(column) * 100 + F.dayofmonth(column)).cast("int")


def _calendar(spark: SparkSession, sf: str) -> TradingCalendar:
    """Weekdays with an order."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").where(F.weekday("o_orderdate") < 5)
    return TradingCalendar.from_column(orders.select(_day("o_orderdate").alias("day")), "day")


def _bar_calendar(bars: DataFrame) -> TradingCalendar:
    return TradingCalendar.from_column(bars, "date")


def _lookup(method: str, *args) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        lines = spark.read.parquet(f"{sf}/lineitem.parquet")
        probes = lines.select("l_orderkey", "l_linenumber", _day("l_shipdate").alias("date"))
        return getattr(_calendar(spark, sf), method)(probes, *args)

    return run


def _on_bars(query: Callable[[DataFrame], DataFrame], fixed: int | None = None) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(_bars(spark, sf))
        return df if fixed is None else _rounded(df, fixed)

    return run


def _weekday_range(bars: DataFrame) -> DataFrame:
    weekdays = bars.where(F.weekday(F.to_date(F.col("date").cast("string"), "yyyyMMdd")) < 5)
    return bars_between(bars, _bar_calendar(weekdays), 20240106, 20240117).select(*KEY, *VALUES)


def _engine(bars: DataFrame, model, plan=features) -> Engine:
    return Engine(bars, _bar_calendar(bars), model=model, plan=plan)


def _two_features(bars: DataFrame) -> DataFrame:
    return features(bars, ["ob_imb0", "trade_imb"])


def _ridge(bars: DataFrame) -> DataFrame:
    train = _two_features(bars)
    return Ridge(["ob_imb0", "trade_imb"]).fit(train).predict(train).select(*KEY, F.round("forecast", 6).alias("forecast"), LABEL)


def _fit_eval(bars: DataFrame) -> DataFrame:
    return _engine(bars, Ridge(["ob_imb0", "trade_imb"]), _two_features).fit(*TRAIN).eval(*TEST)


def _forecast(model) -> Callable[[DataFrame], DataFrame]:
    """Fit on the first days, forecast the rest."""

    def run(bars: DataFrame) -> DataFrame:
        engine = _engine(bars, model()).fit(*TRAIN)
        return engine.predict(engine.features(*TEST))

    return run


def _forecast_rows(model, plan=features) -> Callable[[DataFrame], DataFrame]:
    """The rows that are forecast, and whether each forecast is one a tree of these labels can give.

    A tree's leaf is a mean of training labels; boosting adds shrunken trees of what is left, so it may
    leave their range, but not by more than the range itself in few rounds.
    """

    def run(bars: DataFrame) -> DataFrame:
        engine = _engine(bars, model(), plan).fit(*TRAIN)
        low, high = engine.features(*TRAIN).agg(F.min(LABEL), F.max(LABEL)).first()
        slack = 0.0 if isinstance(engine.model, Tree) else high - low
        return engine.predict(engine.features(*TEST)).select(*KEY, LABEL, F.col("forecast").between(low - slack - 1e-9, high + slack + 1e-9).alias("in_range"))

    return run


def _gbt_eval(bars: DataFrame) -> DataFrame:
    """The main run: 62 features, boosted trees fitted on one range, one row of metrics on the next."""
    return _engine(bars, BoostedTrees(list(FEATURE_NAMES))).fit(*TRAIN).eval(*TEST)


def _ridge_baseline(bars: DataFrame) -> DataFrame:
    train = baseline_features(bars)
    return Ridge(list(BASELINE_NAMES)).fit(train).predict(train).select(*KEY, F.round("forecast", 6).alias("forecast"), LABEL)


def _long_ewm(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted means over series of every event of a type: far more rows than a bar series has."""
    number = F.expr("case event_type when 'view' then 1L when 'click' then 2L when 'purchase' then 3L when 'signup' then 4L else 5L end")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        number.alias("symbol"), _day("ts").alias("date"), F.unix_micros(F.col("ts").cast("timestamp")).alias("interval"),
        F.when(F.col("user_id") % 4 != 0, F.col("value")).alias("x"))
    means = ewm(index_rows(series(rows)), {"by_halflife": ("x", halflife_decay(5)), "by_span": ("x", span_decay(30))}).own()
    return means.select(*KEY, *[F.round(c, 6).alias(c) for c in ("by_halflife", "by_span")])


def _with_infinities(bars: DataFrame) -> DataFrame:
    """Prices over counts that may be zero, as a file written elsewhere may hold them."""
    inf = F.lit(float("inf"))
    return bars.withColumns({
        "high": F.when(F.col("asize0") == 0, inf).otherwise(F.col("high")), "low": F.when(F.col("bsize0") == 0, -inf).otherwise(F.col("low")),
        "open": F.when(F.col("cxlSellQty") > 1, F.lit(float("nan"))).otherwise(F.col("open"))})


def _importance(bars: DataFrame) -> DataFrame:
    engine = _engine(bars, BoostedTrees(list(FEATURE_NAMES))).fit(*TRAIN)
    return split_importance(engine.model, bars.sparkSession)


def _elimination(bars: DataFrame) -> DataFrame:
    table, spark = baseline_features(bars), bars.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/elimination-{uuid.uuid4().hex}"
    return eliminate(table, list(BASELINE_NAMES), root, smallest=3, settings=dict(maxDepth=3, maxIter=3)).log(spark)


def _scaled(bars: DataFrame) -> DataFrame:
    return scaled_bars(bars, VALUES).select(*KEY, *VALUES)


def _loadings(columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    def run(bars: DataFrame) -> DataFrame:
        scaled = _scaled(bars)
        return fit_components(scaled, columns, shift=0.5).loadings(scaled)

    return run


def _scores(bars: DataFrame) -> DataFrame:
    scaled = _scaled(bars)
    return fit_components(scaled, VALUES, shift=0.5).scores(scaled)


def entry(spark: SparkSession) -> DataFrame:
    """All 62 features of the smallest table."""
    return features(_bars(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "bars_from_events": _on_bars(lambda b: b.select(*KEY, *VALUES)),
        "bars_range_scan": _on_bars(_weekday_range),
        "bars_day_scan": _on_bars(lambda b: bars_on(b, _bar_calendar(b), [20240110]).select(*KEY, *VALUES)),
        "symbol_scan": _on_bars(lambda b: bars_of_symbol(b, 90000000).select(*KEY, *VALUES)),
        "cal_is_trading_day": _lookup("is_trading_day"),
        "cal_roll_forward": _lookup("to_trading_day"),
        "cal_next": _lookup("next"),
        "cal_prev": _lookup("prev"),
        "cal_shift": _lookup("shift", -3),
        "cal_shift_ahead": _lookup("shift", 4),
        "cal_prevn": _lookup("prevn", 3),
        "cal_nextn": _lookup("nextn", 3),
        "cal_range": lambda spark, sf: _calendar(spark, sf).range(19960301, 19980615),
        "features_all": _features(FEATURE_NAMES),
        "features_blocked": _features(FEATURE_NAMES, max_rows=200),
        "features_intermediate": _features(INTERMEDIATE_NAMES),
        "features_baseline": _on_bars(lambda b: _rounded(baseline_features(b))),
        "feat_lagret_universe": _features(["lagret12"], mean_scope="universe"),
        "features_label_drop": _features(["ob_imb0", "momentum_midpx", "ema_midpx"], label_null="drop"),
        "eval_metrics": _on_bars(lambda b: metrics(features(b, ["lagret12"]), "lagret12"), 6),
        "ridge_two_features": _on_bars(_ridge),
        "engine_fit_eval": _on_bars(_fit_eval, 6),
        "ridge_baseline": _on_bars(_ridge_baseline),
        "engine_gbt_eval": _on_bars(_gbt_eval),
        "gbt_forecast_rows": _on_bars(_forecast_rows(lambda: BoostedTrees(list(FEATURE_NAMES), settings=dict(maxIter=5, maxDepth=3)))),
        "tree_forecast_rows": _on_bars(_forecast_rows(lambda: Tree(list(FEATURE_NAMES)))),
        "tree_baseline_rows": _on_bars(_forecast_rows(lambda: Tree(list(BASELINE_NAMES)), baseline_features)),
        "feat_ewm_long": _long_ewm,
        "feat_infinite_prices": _on_bars(lambda b: _rounded(features(_with_infinities(b), INFINITE_FEATURES))),
        "eda_missing_infinite": _on_bars(lambda b: missing_check(_with_infinities(b).select("symbol", "interval", "date", *VALUES))),
        "gbt_forecast": _on_bars(_forecast(lambda: BoostedTrees(list(FEATURE_NAMES)))),
        "tree_forecast": _on_bars(_forecast(lambda: Tree(list(FEATURE_NAMES)))),
        "gbt_split_importance": _on_bars(_importance),
        "feature_elimination": _on_bars(_elimination),
        "eda_info": _on_bars(lambda b: info(b.select("symbol", "interval", "date", *VALUES))),
        "eda_describe": _on_bars(describe, 6),
        "eda_histogram": _on_bars(histogram, 6),
        "eda_box": _on_bars(lambda b: box_stats(b, VALUES), 6),
        "eda_missing": _on_bars(missing_check),
        "eda_price_series": _on_bars(price_series),
        "eda_volume_series": _on_bars(volume_series),
        "eda_clean_fill": _on_bars(lambda b: clean_bars(b).select(*KEY, *BAR_COLUMNS, F.round(LABEL, 9).alias(LABEL))),
        "eda_clean_fill_blocked": _on_bars(
            lambda b: clean_bars(b, max_rows=150).select(*KEY, *BAR_COLUMNS, F.round(LABEL, 9).alias(LABEL))),
        "eda_ffill": _on_bars(lambda b: ffill(series(b), VALUES).own().select(*KEY, *VALUES)),
        "eda_bfill": _on_bars(lambda b: bfill(series(b), VALUES).own().select(*KEY, *VALUES)),
        "eda_fill_mean": _on_bars(lambda b: fill_mean(b, VALUES).select(*KEY, *VALUES), 6),
        "eda_clean_drop": _on_bars(lambda b: clean_bars(b, fill=False).select(*KEY, *VALUES)),
        "eda_minmax": _on_bars(_scaled, 9),
        "eda_pca_two": _on_bars(_loadings(["midpx", "tradeBuyQty"]), 6),
        "eda_pca_loadings": _on_bars(_loadings(VALUES), 6),
        "eda_pca_scores": _on_bars(_scores, 6),
    }
    named |= {name: _features(names) for name, names in FAMILIES.items()}
    if training is not None:
        named |= training.queries() | {"pipeline": corpus_pipeline.run}
    return named


def oracle_sql() -> dict[str, str]:
    sql = all_sql(FAMILIES, INFINITE_FEATURES)
    if training is not None:
        sql |= training.oracle_sql() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return sql
