"""Column expressions shared by the operators."""

from holdfast.functions.columns import (
    finite_or_null,
    floor_at_zero,
    is_finite,
    log_target,
    parse_number,
    unlog_target,
)

__all__ = [
    "finite_or_null",
    "floor_at_zero",
    "is_finite",
    "log_target",
    "parse_number",
    "unlog_target",
]
