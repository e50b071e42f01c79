"""Derived columns of the call mart, as expressions over the call facts.

A missing value makes a condition unknown, and an unknown condition falls to
the ``ELSE`` branch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from dialtone import config as fixed


# All values of the two attributes that a call's lookups give it.
CALL_TYPES = (fixed.CALL_TYPE_LEASE, fixed.CALL_TYPE_SITE)
INTENTS = (*fixed.INTENT_LABELS.values(), fixed.INTENT_NONE)


def tenure_bucket(hired: str, called: str) -> str:
    """Days since hire in steps of thirty; unknown or long ago is a veteran."""
    steps = " ".join(
        f"WHEN datediff({called}, {hired}) <= {limit} THEN '{label}'" for limit, label in fixed.TENURE_LIMITS)
    return f"CASE {steps} ELSE '{fixed.TENURE_VETERAN}' END"


def call_type(lease_flag: str, number: str, non_lease_numbers: Sequence[str]) -> Column:
    """Lease calls are flagged ones whose known number is not on the list."""
    is_lease = F.expr(f"{lease_flag} = 1 AND {number} IS NOT NULL")
    if non_lease_numbers:
        is_lease = is_lease & ~F.col(number).isin(*non_lease_numbers)
    return F.when(is_lease, fixed.CALL_TYPE_LEASE).otherwise(fixed.CALL_TYPE_SITE)


def mover_switcher(intent: str) -> str:
    said = " ".join(f"WHEN '{text}' THEN '{label}'" for text, label in fixed.INTENT_LABELS.items())
    return f"CASE upper({intent}) {said} ELSE '{fixed.INTENT_NONE}' END"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def passed_credit_call(passed: str, credit: str) -> str:
    return flag(f"{passed} > 0 AND coalesce({credit}, 0) > 0")


def failed_credit_call(passed: str, credit: str) -> str:
    """Failed means passed is exactly 0; an unknown outcome is no failure."""
    return flag(f"coalesce({credit}, 0) = 1 AND {passed} = 0")


def passed_credit_sale(sold: str, passed: str) -> str:
    return flag(f"{sold} > 0 AND {passed} > 0")


def failed_credit_sale(sold: str, passed: str, orders: str) -> str:
    return flag(f"{sold} > 0 AND {passed} = 0 AND coalesce({orders}, 0) > 0")


def minutes(seconds: str) -> str:
    return f"CAST({seconds} AS DOUBLE) / 60"


def top_product(day: str, points: str, prepaid: str) -> str:
    """Top-product sale: by points, whose threshold changed once, or by a
    prepaid order after such orders began to count."""
    change = f"DATE '{fixed.POINTS_CHANGE_DATE}'"
    needed = f"if({day} < {change}, {fixed.POINTS_BEFORE_CHANGE}, {fixed.POINTS_FROM_CHANGE})"
    by_prepaid = f"{day} > DATE '{fixed.PREPAID_COUNTS_AFTER}' AND coalesce({prepaid}, 0) = 1"
    return flag(f"{day} IS NOT NULL AND (coalesce({points}, 0) >= {needed} OR {by_prepaid})")
