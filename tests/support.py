"""Random bars and a straightforward pandas statement of the features."""

import numpy as np
import pandas as pd

from barloom.sources.schema import BAR_COLUMNS

EPS = 1e-9


def random_bars(symbols=3, days=8, per_day=20, seed=0, gaps=0.1, infs=0.02, shuffle=True):
    rng = np.random.default_rng(seed)
    frames = []
    for s in range(symbols):
        n = days * per_day
        f = pd.DataFrame({
            "symbol": 90000000 + s,
            "date": np.repeat([20240102 + d for d in range(days)], per_day).astype("int32"),
            "interval": np.tile(93000 + 3000 * np.arange(per_day), days).astype("int64"),
        })
        price = 50 + np.cumsum(rng.normal(0, 0.2, n))
        price[n // 3: n // 3 + 9] = price[n // 3]
        for c in BAR_COLUMNS:
            f[c] = np.round(price + rng.normal(0, 0.05, n), 2) if c in ("open", "high", "low", "lastpx", "bid0", "ask0") \
                else rng.integers(0, 40, n).astype(float)
        f["midpx"] = np.round(price, 2)
        f["fret12"] = f["midpx"].shift(-12) / f["midpx"] - 1
        frames.append(f)
    df = pd.concat(frames, ignore_index=True)
    for c in (*BAR_COLUMNS, "fret12"):
        hit = rng.random(len(df))
        df.loc[hit < gaps, c] = np.nan
        df.loc[hit > 1 - infs, c] = np.inf
    return df.sample(frac=1, random_state=seed) if shuffle else df


def pandas_features(bars: pd.DataFrame, scope="symbol") -> pd.DataFrame:
    """All features and intermediates, from missing = NaN data (infinities removed first)."""
    df = bars.sort_values(["symbol", "date", "interval"]).reset_index(drop=True)
    df = df.replace([np.inf, -np.inf], np.nan)
    g = df.groupby("symbol", group_keys=False)
    out = df[["symbol", "date", "interval"]].copy()

    def per(values, fn):
        return values.groupby(df["symbol"], group_keys=False).apply(fn)

    def imb(a, b):
        return (df[a] - df[b]) / (df[a] + df[b] + EPS)

    def lg(x):
        with np.errstate(all="ignore"):
            return np.log1p(x.fillna(0)).replace([np.inf, -np.inf], np.nan)

    out["ob_imb0"], out["ob_imb4"], out["ob_imb9"] = imb("asize0", "bsize0"), imb("asize0_4", "bsize0_4"), imb("asize5_9", "bsize5_9")
    ti = out["trade_imb"] = imb("tradeBuyQty", "tradeSellQty")
    out["trade_imbema5"] = per(ti, lambda x: x.ewm(halflife=5).mean())
    past = g["midpx"].shift(12)
    br = out["bret12"] = (df["midpx"] - past) / (past + EPS)
    keys = [df["interval"]] if scope == "universe" else [df["symbol"], df["interval"]]
    out["cx_bret12"] = br.groupby(keys).transform("mean")
    out["lagret12"] = br - out["cx_bret12"]
    for c in ("midpx", "high", "low", "open", "lastpx", "tradeBuyQty", "tradeSellQty"):
        out[f"trend_{c}"] = g[c].diff()
        out[f"moving_avg_{c}_5"] = per(df[c], lambda x: x.rolling(5).mean())
    out["momentum_midpx"] = g["midpx"].diff(5)
    out["momentum_trade_imb"] = per(ti, lambda x: x.diff(5))
    for n, a, b in (("diff_high_low", "high", "low"), ("spread_high_low", "high", "low"), ("diff_open_close", "open", "lastpx"),
                    ("diff_midpx_open", "midpx", "open"), ("diff_lastpx_midpx", "lastpx", "midpx"),
                    ("diff_bid0_ask0", "bid0", "ask0"), ("spread_bid_ask", "ask0", "bid0")):
        out[n] = df[a] - df[b]
    for n, a, b in (("ratio_high_low", "high", "low"), ("ratio_open_close", "open", "lastpx"), ("ratio_midpx_open", "midpx", "open"),
                    ("ratio_lastpx_midpx", "lastpx", "midpx"), ("ratio_tradeBuyQty_tradeSellQty", "tradeBuyQty", "tradeSellQty"),
                    ("ratio_high_bid0", "high", "bid0"), ("ratio_ask0_open", "ask0", "open"), ("ratio_lastpx_bid0", "lastpx", "bid0"),
                    ("ratio_bid_ask", "bid0", "ask0"), ("ratio_high_ask0", "high", "ask0"), ("ratio_low_bid0", "low", "bid0")):
        out[n] = df[a] / (df[b] + EPS)
    for c in ("midpx", "high", "low", "open", "lastpx", "tradeBuyQty", "tradeSellQty", "ask0", "bid0"):
        out[f"log_{c}"] = lg(df[c])
    for c in ("ob_imb0", "ob_imb4", "trade_imbema5", "lagret12"):
        out[f"log_{c}"] = lg(out[c])
    roll = {k: per(df["midpx"], lambda x, k=k: getattr(x.rolling(5), k)()) for k in ("mean", "std", "skew", "kurt", "max", "min")}
    out["rolling_mean_midpx_5"] = out["mean_midpx_last_N"] = roll["mean"]
    out["rolling_std_midpx_5"] = out["volatility_midpx_5"] = roll["std"]
    out["rolling_skew_midpx_5"], out["rolling_kurt_midpx_5"] = roll["skew"], roll["kurt"]
    out["max_midpx_last_N"], out["min_midpx_last_N"] = roll["max"], roll["min"]
    out["rolling_mean_tradeBuyQty_5"], out["rolling_mean_tradeSellQty_5"] = out["moving_avg_tradeBuyQty_5"], out["moving_avg_tradeSellQty_5"]
    out["volatility_log_midpx"] = per(out["log_midpx"], lambda x: x.rolling(5).std())
    out["momentum_log_midpx"] = per(out["log_midpx"], lambda x: x.diff())
    std = {c: per(df[c], lambda x: x.rolling(5).std()) for c in ("high", "low")}
    out["volatility_high_low"] = std["high"] - std["low"]
    out["product_midpx_tradeBuyQty"] = df["midpx"] * df["tradeBuyQty"]
    out["ema_trade_imb"] = per(ti, lambda x: x.ewm(span=30).mean())
    for c in ("midpx", "high", "low", "open", "lastpx"):
        out[f"ema_{c}"] = per(df[c], lambda x: x.ewm(span=30).mean())
    for c in ("cxlSellHigh", "cxlSellTurnover", "cxlSellQty"):
        out[c] = df[c]
    out["fret12"] = df["fret12"]
    return out.replace([np.inf, -np.inf], np.nan).fillna(0)
