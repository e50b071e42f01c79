"""Ratios with the missing-value rules of the reports."""

from __future__ import annotations


def double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def safe_rate(num: str, den: str) -> str:
    """num / den, NULL unless the denominator is above zero."""
    return f"CASE WHEN {den} > 0 THEN {double(num)} / {double(den)} END"


def safe_ratio(num: str, den: str) -> str:
    """num / den, NULL only when the denominator is zero or missing."""
    return f"try_divide({double(num)}, {double(den)})"


def relative_delta(value: str, base: str) -> str:
    """value / base - 1, NULL if either is missing or the base is zero."""
    return f"({safe_ratio(value, base)} - 1)"


def pct_change(before: str, after: str) -> str:
    """Change from ``before`` to ``after`` in percent."""
    return f"({relative_delta(after, before)} * 100D)"


def weighted_average(value: str, weight: str) -> str:
    """Weighted mean over the rows where ``value`` is present."""
    return safe_ratio(
        f"sum({value} * {weight})", f"sum(CASE WHEN {value} IS NOT NULL THEN {weight} END)")


def total(x: str) -> str:
    """Sum that is zero, not NULL, when there is nothing to add."""
    return f"coalesce(sum({x}), 0)"
