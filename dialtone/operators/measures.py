"""Additive measures: the sums every KPI is a ratio of.

A measure is a per-call number whose sum over any set of calls is meaningful.
Reports group calls, add the measures up and divide, so one pass over the
calls serves all metrics of a report. As sums of sums are sums, the same
report can read a rollup (calls already added up per day and dimension) in
place of the calls; its measure columns are recognised by their prefix.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from dialtone.functions import scopes
from dialtone.functions.rates import total

PREFIX = "m_"

# The dimensions a rollup keeps: all that reports filter or group by.
ROLLUP_KEYS = (
    "call_date_est", "membership", "center_location", "marketing_bucket",
    "moverSwitcher", "tenure_bucket", "call_type", "agent_name",
)


# The call-mart column that a measure adds up. A rollup of calls without it has no such measure, so that a report can
# tell what is unknown from what is zero, as it can from the calls.
MEASURED = {
    "contact": "ib_contact_calls", "credit": "credit_calls_flag", "passed": "passed_credit_call_flag",
    "failed": "failed_credit_call_flag", "passed_sale": "passed_credit_sale_flag",
    "failed_sale": "failed_credit_sale_flag", "orders": "orders", "inbound_orders": "orders",
    "top_product": "tpsales_flag", "inbound_top_product": "tpsales_flag",
}


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


def call_measures(columns: Sequence[str]) -> dict[str, str]:
    """Measures of call-mart rows, by name without prefix.

    A column that the data does not have contributes nothing (talk times and
    so their means stay NULL). ``revenue`` falls back on the order value where
    the data has no total revenue, ``stated_revenue`` does not.
    """
    have = set(columns)
    inbound, selling = scopes.top_funnel(have), scopes.order_revenue(have)

    def amount(column: str) -> str:
        return f"coalesce({column}, 0)" if column in have else "0"

    revenue = amount("total_revenue" if "total_revenue" in have else "gcv_fo")
    measures = {
        "rows": "1",
        "calls": _when(inbound, "1"),
        "contact": _when(inbound, amount("ib_contact_calls")),
        "credit": _when(inbound, amount("credit_calls_flag")),
        "passed": _when(inbound, amount("passed_credit_call_flag")),
        "failed": _when(inbound, amount("failed_credit_call_flag")),
        "passed_sale": _when(inbound, amount("passed_credit_sale_flag")),
        "failed_sale": _when(inbound, amount("failed_credit_sale_flag")),
        "orders": _when(selling, amount("orders")),
        "top_product": _when(selling, amount("tpsales_flag")),
        "revenue": _when(selling, revenue),
        "stated_revenue": _when(selling, amount("total_revenue")),
        "inbound_orders": _when(inbound, amount("orders")),
        "inbound_top_product": _when(inbound, amount("tpsales_flag")),
    }
    # decimals, so that a sum is the same in whatever order it is taken
    talked = "CAST(" + ("talk_time_minutes" if "talk_time_minutes" in have else "NULL") + " AS DECIMAL(28,10))"
    ordered = "orders" if "orders" in have else "CAST(NULL AS BIGINT)"
    for name, condition in {"talk": "true", "sold": f"{ordered} > 0", "unsold": f"{ordered} = 0"}.items():
        timed = f"{inbound} AND {condition} AND {talked} IS NOT NULL"
        measures[name + "_minutes"] = _when(timed, talked)
        measures[name + "_calls"] = _when(timed, "1")
    return measures


def lift_measures(columns: Sequence[str]) -> dict[str, str]:
    """Measures of lift facts. Unlike in the call mart a credit call has failed
    when it did not pass, an unknown outcome included."""
    have = set(columns)
    inbound, selling = scopes.top_funnel(have), scopes.order_revenue(have)

    def amount(column: str) -> str:
        return f"coalesce({column}, 0)" if column in have else "0"

    passed = failed = "false"
    if "passed_credit_call_ind" in have:
        passed = f"{inbound} AND passed_credit_call_ind = 1"
        if "credit_calls_ind" in have:
            failed = f"{inbound} AND credit_calls_ind = 1 AND NOT (passed_credit_call_ind <=> 1)"
    sold = "order_orders > 0" if "order_orders" in have else "false"
    return {
        "rows": "1",
        "calls": _when(inbound, "1"),
        "orders": _when(selling, amount("order_orders")),
        "revenue": _when(selling, amount("gcv_revenue")),
        "talk_minutes": _when(inbound, f"CAST({amount('talk_time_minutes')} AS DOUBLE)"),
        "contact": _when(inbound, amount("ib_contact_calls")),
        "credit": _when(inbound, amount("credit_calls_ind")),
        "passed": _when(passed, "1"),
        "failed": _when(failed, "1"),
        "passed_sale": _when(f"{passed} AND {sold}", "1"),
        "failed_sale": _when(f"{failed} AND {sold}", "1"),
    }


def _stored(df: DataFrame) -> dict[str, str] | None:
    """Measures that ``df`` already holds as columns, if it is a rollup."""
    if PREFIX + "rows" not in df.columns:
        return None
    return {c.removeprefix(PREFIX): c for c in df.columns if c.startswith(PREFIX)}


def current_measures(df: DataFrame) -> dict[str, str]:
    """Measures of ``df``, which may hold calls or a rollup of calls. One that a rollup does not have is zero."""
    stored = _stored(df)
    return {**dict.fromkeys(MEASURED, "0"), **stored} if stored else call_measures(df.columns)


def known_measures(columns: Iterable[str]) -> set[str]:
    """Of the measures that add up one column, those whose column the data has, or had when it was rolled up."""
    have = set(columns)
    if PREFIX + "rows" in have:
        return {n for n in MEASURED if PREFIX + n in have}
    return {n for n, c in MEASURED.items() if c in have}


def _summed(df: DataFrame, keys: Sequence[str], measures: dict[str, str]) -> DataFrame:
    sums = [F.expr(f"{total(x)} AS {PREFIX}{n}") for n, x in measures.items()]
    return df.groupBy(*[F.expr(k) for k in keys]).agg(*sums) if keys else df.agg(*sums)


def summarise(df: DataFrame, *keys: str) -> DataFrame:
    """Sums of all call measures per ``keys`` (columns or expressions with a
    name); one row if there are no keys."""
    return _summed(df, keys, current_measures(df))


def summarise_lift(df: DataFrame, *keys: str) -> DataFrame:
    """Sums of all lift measures per ``keys``; one row if there are no keys."""
    return _summed(df, keys, _stored(df) or lift_measures(df.columns))


def daily_rollup(calls: DataFrame, keys: Sequence[str] = ROLLUP_KEYS) -> DataFrame:
    """Calls added up per day and dimension: one scan that all reports can share.

    It has no measure of a column that the calls do not have.
    """
    known = known_measures(calls.columns)
    measures = {n: x for n, x in current_measures(calls).items() if n not in MEASURED or n in known}
    return _summed(calls, [k for k in keys if k in calls.columns], measures)
