"""Display texts of report values and the class of a change.

``format_number`` rounds half-even on the exact binary value, which is what
the report texts are defined by; ``round`` would not.
"""

from __future__ import annotations

from dialtone.config import LOWER_IS_BETTER, NEUTRAL_CHANGE_PCT

MISSING = "—"


def _number(value: str, pattern: str) -> str:
    return f"format_number(CAST({value} AS DOUBLE), '{pattern}')"


def as_count(value: str) -> str:
    return _number(value, "#,##0")


def as_pct(value: str) -> str:
    return f"concat({_number(f'{value} * 100', '0.0')}, '%')"


def as_dollars(value: str, places: int = 2) -> str:
    return f"concat('$', {_number(value, '#,##0' + ('.' + '0' * places if places else ''))})"


def as_decimal(value: str, places: int = 2) -> str:
    return _number(value, "0." + "0" * places)


def as_signed_pct(pct: str) -> str:
    """A change that is already in percent, with its sign."""
    return f"concat({_number(pct, '+0.0;-0.0')}, '%')"


def as_points(fraction: str, unit: str = "%") -> str:
    """A delta given as a fraction; only a positive one carries a sign."""
    return f"concat(if({fraction} > 0, '+', ''), {_number(f'{fraction} * 100', '0.0')}, '{unit}')"


def or_missing(text: str) -> str:
    return f"coalesce({text}, '{MISSING}')"


def display(value: str, kind: str, dollar_places: int = 2) -> str:
    """Text of ``value`` by the row's format kind."""
    return or_missing(f"""CASE {kind} WHEN 'count' THEN {as_count(value)} WHEN 'pct' THEN {as_pct(value)}
        WHEN 'dollar' THEN {as_dollars(value, dollar_places)} ELSE {as_decimal(value)} END""")


def change_class(metric: str, pct: str) -> str:
    """'better', 'worse' or 'neutral' for a percent change; NULL if there is none.

    The class follows the change as displayed, that is with one decimal.
    """
    shown = f"CAST({_number(pct, '0.0')} AS DOUBLE)"
    lower = ", ".join(f"'{m}'" for m in LOWER_IS_BETTER)
    return f"""CASE WHEN {pct} IS NULL OR isnan({pct}) OR abs({pct}) = double('Infinity') THEN NULL
        WHEN abs({shown}) < {NEUTRAL_CHANGE_PCT}D THEN 'neutral'
        WHEN if({metric} IN ({lower}), {shown} < 0, {shown} > 0) THEN 'better' ELSE 'worse' END"""
