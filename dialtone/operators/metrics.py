"""Metric registries: each metric is a ratio of summed measures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame

from dialtone.config import COST_PER_MINUTE
from dialtone.functions.rates import double, safe_rate, safe_ratio
from dialtone.operators.measures import known_measures


class Metric(NamedTuple):
    """A value of a group of calls, as an expression over the group's summed
    measures, and how it is displayed."""

    kind: str
    value: str


Registry = Mapping[str, Metric]


def _sum(kind: str, measure: str) -> Metric:
    return Metric(kind, double("m_" + measure))


def _rate(kind: str, num: str, den: str) -> Metric:
    return Metric(kind, safe_rate("m_" + num, "m_" + den))


def _ratio(kind: str, num: str, den: str) -> Metric:
    return Metric(kind, safe_ratio("m_" + num, "m_" + den))


# The funnel counts orders and revenue of inbound and manually dialled calls,
# everything else of inbound calls only.
FUNNEL: Registry = {
    "Calls": _sum("count", "calls"),
    "CiContact": _rate("pct", "contact", "calls"),
    "CiCredit": _rate("pct", "credit", "calls"),
    "PCR": _rate("pct", "passed", "credit"),
    "PCC": _rate("pct", "passed_sale", "passed"),
    "FCC": _rate("pct", "failed_sale", "failed"),
    "NC": _rate("pct", "orders", "calls"),
    "TPM": _rate("pct", "top_product", "orders"),
    "Revenue": _sum("dollar", "revenue"),
    "RPNC": _rate("dollar", "revenue", "calls"),
    "RPO": _rate("dollar", "revenue", "orders"),
    "Talk Time": _rate("decimal", "talk_minutes", "talk_calls"),
    "Sold Talk Time": _rate("decimal", "sold_minutes", "sold_calls"),
    "Unsold Talk Time": _rate("decimal", "unsold_minutes", "unsold_calls"),
}

# The trend takes both sides of every percentage from inbound calls, so its net
# conversion and top-product mix differ from the funnel's NC and TPM.
TREND: Registry = {
    "Net Conversion": _rate("pct", "inbound_orders", "calls"),
    "Total Revenue": _sum("dollar", "revenue"),
    "Rev / Call": _rate("dollar", "stated_revenue", "calls"),
    "Rev / Order": _rate("dollar", "stated_revenue", "orders"),
    "Top Product Mix": _rate("pct", "inbound_top_product", "inbound_orders"),
    "Contact Rate": _rate("pct", "contact", "calls"),
    "Credit Rate": _rate("pct", "credit", "calls"),
    "Passed Credit Rate": _rate("pct", "passed", "credit"),
    "Passed Credit Conv.": _rate("pct", "passed_sale", "passed"),
    "Failed Credit Conv.": _rate("pct", "failed_sale", "failed"),
    "Talk Time": _rate("decimal", "talk_minutes", "talk_calls"),
    "Calls": _sum("count", "calls"),
}

# The measure in the numerator of a trend percentage: where the data lacks the column that it adds up the metric is
# unknown, while the funnel counts such a column as zero.
TREND_NUMERATORS = {
    "Net Conversion": "inbound_orders", "Top Product Mix": "inbound_top_product", "Contact Rate": "contact",
    "Credit Rate": "credit", "Passed Credit Rate": "passed", "Passed Credit Conv.": "passed_sale",
    "Failed Credit Conv.": "failed_sale",
}

TOTALS: Registry = {
    "n_calls": _sum("count", "calls"),
    "contact_rate": _rate("pct", "contact", "calls"),
    "credit_rate": _rate("pct", "credit", "calls"),
    "pass_credit_rate": _rate("pct", "passed", "credit"),
    "fail_credit_rate": _rate("pct", "failed", "credit"),
    "pass_credit_conv": _rate("pct", "passed_sale", "passed"),
    "fail_credit_conv": _rate("pct", "failed_sale", "failed"),
    "net_conversion": _rate("pct", "orders", "calls"),
    "top_product_mix": _rate("pct", "top_product", "orders"),
    "total_revenue": _sum("dollar", "revenue"),
    "rev_per_call": _rate("dollar", "revenue", "calls"),
    "rev_per_order": _rate("dollar", "revenue", "orders"),
    "talk_time": _rate("decimal", "talk_minutes", "talk_calls"),
    "talk_time_sold": _rate("decimal", "sold_minutes", "sold_calls"),
    "talk_time_unsold": _rate("decimal", "unsold_minutes", "unsold_calls"),
}

WEEK_CARDS: Registry = {
    "Rev / Call": _rate("dollar", "stated_revenue", "calls"),
    "Net Conversion": _rate("pct", "orders", "calls"),
    "Rev / Order": _rate("dollar", "stated_revenue", "orders"),
    "Calls Into Credit": _rate("pct", "credit", "calls"),
    "Talk Time": _rate("decimal", "talk_minutes", "talk_calls"),
}

AGENT: Registry = {
    "net_conv": _rate("pct", "orders", "calls"),
    "top_product_mix": _rate("pct", "top_product", "orders"),
    "total_revenue": _sum("dollar", "revenue"),
    "rev_per_call": _rate("dollar", "revenue", "calls"),
    "rev_per_order": _rate("dollar", "revenue", "orders"),
    "talk_time": _rate("decimal", "talk_minutes", "talk_calls"),
    "sold_talk_time": _rate("decimal", "sold_minutes", "sold_calls"),
}

# Lift divides unless the denominator is exactly zero; talk time is minutes per
# inbound call, not a mean over calls with a known time.
LIFT: Registry = {
    "contact_rate": _ratio("pct", "contact", "calls"),
    "credit_rate": _ratio("pct", "credit", "calls"),
    "pass_credit_rate": _ratio("pct", "passed", "credit"),
    "pass_credit_conv": _ratio("pct", "passed_sale", "passed"),
    "fail_credit_conv": _ratio("pct", "failed_sale", "failed"),
    "nc": _ratio("pct", "orders", "calls"),
    "rpo": _ratio("dollar", "revenue", "orders"),
    "rpnc": _ratio("dollar", "revenue", "calls"),
    "tt": _ratio("decimal", "talk_minutes", "calls"),
    "cm_call": Metric("dollar", safe_ratio("m_revenue", "m_calls")
                      + f" - {COST_PER_MINUTE}D * " + safe_ratio("m_talk_minutes", "m_calls")),
}
LIFT_VOLUMES: Registry = {
    "net_call": _sum("count", "calls"),
    "orders": _sum("count", "orders"),
    "revenue": _sum("dollar", "revenue"),
}

# Display names of the lift KPIs and the five that head the report.
LIFT_NAMES = {
    "contact_rate": "Contact Rate",
    "credit_rate": "Calls Into Credit",
    "pass_credit_rate": "Passed Credit Rate",
    "pass_credit_conv": "Passed Credit Conv.",
    "fail_credit_conv": "Failed Credit Conv.",
    "nc": "Net Conversion",
    "rpo": "RPO",
    "rpnc": "RPNC",
    "tt": "Talk Time",
    "cm_call": "CM / Call",
}
LIFT_HEADLINES = ("rpnc", "nc", "rpo", "credit_rate", "tt")


def chosen(registry: Registry, names: Iterable[str] | None) -> Registry:
    """The registry, or the named part of it; an unknown name is an error."""
    return registry if names is None else {n: registry[n] for n in names}


def trend_of(columns: Iterable[str], registry: Registry) -> Registry:
    """``registry`` for data of these columns, which may be those of a rollup."""
    known = known_measures(columns)
    unknown = {n for n, measure in TREND_NUMERATORS.items() if measure not in known}
    return {n: m._replace(value=double("NULL")) if n in unknown else m for n, m in registry.items()}


def wide(summed: DataFrame, registry: Registry, *keys: str) -> DataFrame:
    """One column per metric next to the keys."""
    return summed.selectExpr(*keys, *[f"{m.value} AS `{n}`" for n, m in registry.items()])


def long(summed: DataFrame, registry: Registry, *keys: str) -> DataFrame:
    """One row per metric: keys, position, metric, kind, value."""
    rows = ", ".join(
        f"struct({i} AS position, '{n}' AS metric, '{m.kind}' AS kind, {m.value} AS value)"
        for i, (n, m) in enumerate(registry.items(), 1))
    return summed.selectExpr(*keys, f"inline(array({rows}))")
