"""Null-safe arithmetic as SQL text, shared by every operator.

Missing data has one form inside the engine: NULL. ``finite`` maps NaN and the
infinities to NULL at the edge, ``zero`` does the closing 0-fill. The helpers
take and return SQL expressions, so a plan of a hundred columns is a hundred
``F.expr`` calls and not thousands of column objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

# Fixed value: the term added to every guarded denominator.
EPSILON = "1e-9D"


def is_finite(x: str) -> str:
    """True for numbers; NULL or false for NULL, NaN (which sorts above inf) and +-inf."""
    return f"abs({x}) < double('Infinity')"


def finite(x: str) -> str:
    """NaN and +-inf become NULL."""
    return f"if({is_finite(x)}, {x}, null)"


def zero(x: str) -> str:
    """NULL, NaN and +-inf become 0."""
    return f"if({is_finite(x)}, {x}, 0D)"


def ratio(a: str, b: str) -> str:
    """a / (b + epsilon); NULL instead of an ANSI error if the sum is exactly 0."""
    return f"try_divide({a}, {b} + {EPSILON})"


def imbalance(a: str, b: str, guard: bool = True) -> str:
    """(a - b) / (a + b), with epsilon in the denominator unless ``guard`` is off."""
    return ratio(f"({a} - {b})", f"{a} + {b}") if guard else f"try_divide({a} - {b}, {a} + {b})"


def log1p0(x: str) -> str:
    """log(1 + x) of the 0-filled value; NULL for x <= -1."""
    return f"log1p({zero(x)})"


def float_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in exclude
    ]


def clean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Map NaN and +-inf to NULL in the given (default: all) floating columns."""
    chosen = set(float_columns(df) if columns is None else columns)
    return df.select(*[F.expr(f"{finite(f'`{c}`')} as `{c}`") if c in chosen else F.col(c) for c in df.columns])
