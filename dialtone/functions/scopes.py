"""Which calls count for the top of the funnel and which for revenue."""

from __future__ import annotations

from collections.abc import Collection

from dialtone.config import INBOUND, MANUAL_OUTBOUND


def top_funnel(columns: Collection[str]) -> str:
    """Inbound calls; never NULL.

    ``columns`` says what the data has: without a direction the ``ibcalls``
    flag decides, without either every call counts.
    """
    if "call_direction" in columns:
        return f"coalesce(upper(call_direction) = '{INBOUND}', false)"
    if "ibcalls" in columns:
        return "coalesce(ibcalls = 1, false)"
    return "true"


def order_revenue(columns: Collection[str]) -> str:
    """Inbound and manually dialled calls; never NULL."""
    if "call_direction" in columns:
        return f"coalesce(upper(call_direction) IN ('{INBOUND}', '{MANUAL_OUTBOUND}'), false)"
    return "true"
