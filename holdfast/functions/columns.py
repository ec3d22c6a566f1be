"""Column expressions: parsing, missing values, target transforms.

Every function takes and returns a ``Column`` so the work stays inside
whole-stage codegen. Missing is always NULL, never NaN: Spark orders NaN
above infinity and lets one NaN poison ``avg`` and ``regr_slope``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the number literals a column may hold as text, lower-cased and
# trimmed. Stricter than a Spark cast, which would also accept '1d' and '1.0f'.
NUMBER_PATTERN = r"^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"

INFINITY = float("inf")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for ordinary numbers; false (never NULL) for NULL, NaN and +-inf."""
    c = as_column(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def finite_or_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(is_finite(c), c)


def nan_to_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def strip(c: Column | str) -> Column:
    """Text without white space at its ends: tabs, line ends and no-break blanks too."""
    return F.regexp_replace(as_column(c), r"(?U)^\s+|\s+$", "")


def parse_number(c: Column | str) -> Column:
    """Text to double; anything that is not a number literal becomes NULL."""
    text = F.lower(strip(c))
    return nan_to_null(F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double")))


def floor_at_zero(c: Column | str) -> Column:
    """``max(c, 0)`` that keeps NULL (``greatest`` alone would turn it into 0)."""
    c = as_column(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def clip(c: Column | str, low: Column, high: Column) -> Column:
    """Lower bound first, then upper bound; a NULL bound is unbounded."""
    c = as_column(c)
    raised = F.when(c < low, low).otherwise(c)
    return F.when(raised > high, high).otherwise(raised)


def log_target(y: Column | str) -> Column:
    return F.log1p(floor_at_zero(y))


def unlog_target(p: Column | str) -> Column:
    return floor_at_zero(F.expm1(as_column(p)))
