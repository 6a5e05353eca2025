"""Digits at which a query and its SQL are compared.

Row arithmetic is the same in both engines bit for bit and is left alone.
Sums in another order, logarithms and powers differ in the last bits.
"""

EXACT = ("ob_imb", "trend_", "diff_", "spread_", "ratio_", "product_", "cxl", "momentum_midpx", "momentum_trade_imb", "max_", "min_")


def digits(name: str) -> int | None:
    if name == "trade_imb" or name.startswith(EXACT):
        return None
    return 6
