"""Agent scorecards, their summary and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialtone.functions import formats
from dialtone.operators import filters, metrics as m
from dialtone.operators.measures import PREFIX, summarise

AGENT = "agent_name"
# Output name of each modal column, and the sortable columns.
MODAL = {"center": "center_location", "membership": "membership", "tenure": "tenure_bucket"}
SORTABLE = {
    "Calls": "calls", "Net Conv.": "net_conv", "Rev / Call": "rev_per_call",
    "Rev / Order": "rev_per_order", "Top Product Mix": "top_product_mix",
    "Total Revenue": "total_revenue", "Talk Time": "talk_time", "Sold Talk Time": "sold_talk_time",
}
BINS = 20


def agent_scorecard(calls: DataFrame, search: str = "") -> DataFrame:
    """One row per agent.

    Calls are first added up per agent and modal dimensions, which is a plain
    hash aggregation with fixed-size state; modes and totals then come from
    those few rows. The most frequent value wins, among equals the smallest,
    and an agent without any value has none.
    """
    named = filters.name_matches(calls, AGENT, search).filter(f"{AGENT} IS NOT NULL")
    modal = {n: c for n, c in MODAL.items() if c in calls.columns}
    cells = summarise(named, AGENT, *modal.values())
    summed = [c for c in cells.columns if c.startswith(PREFIX)]

    # counts of each value of each modal dimension, next to the agent's totals
    views = cells.groupingSets(
        [[AGENT], *[[AGENT, c] for c in modal.values()]], AGENT, *modal.values()
    ).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in summed],
        *[F.expr(f"grouping({c}) = 0 AS _by_{n}") for n, c in modal.items()],
    )
    is_total = "NOT (" + " OR ".join(["false", *[f"_by_{n}" for n in modal]]) + ")"
    per_agent = views.groupBy(AGENT).agg(
        *[F.expr(f"max({c}) FILTER (WHERE {is_total}) AS {c}") for c in summed],
        *[
            F.expr(f"min(struct(-m_rows AS n, {c} AS v)) FILTER (WHERE _by_{n} AND {c} IS NOT NULL).v AS {n}")
            for n, c in modal.items()
        ],
    )
    labels = [n if n in modal else f"'{formats.MISSING}' AS {n}" for n in MODAL]
    return m.wide(per_agent, m.AGENT, f"{AGENT} AS agent", "CAST(m_calls AS BIGINT) AS calls", *labels)


def sort_agents(scorecard: DataFrame, by: str = "Calls", ascending: bool = False) -> DataFrame:
    """Scorecard ordered by one of its columns; missing values last either way."""
    column = F.col(SORTABLE[by])
    return scorecard.orderBy(column.asc_nulls_last() if ascending else column.desc_nulls_last(), "agent")


def show_agents(scorecard: DataFrame) -> DataFrame:
    """Display texts of the scorecard."""
    def text(column: str, shown: str) -> str:
        return f"{formats.or_missing(shown)} AS {column}"

    return scorecard.selectExpr(
        "agent", text("calls", formats.as_count("calls")), *MODAL,
        *[text(c, formats.as_pct(c)) for c in ("net_conv", "top_product_mix")],
        *[text(c, formats.as_dollars(c)) for c in ("total_revenue", "rev_per_call", "rev_per_order")],
        *[text(c, formats.as_decimal(c, 1)) for c in ("talk_time", "sold_talk_time")],
    )


def roster_summary(scorecard: DataFrame) -> DataFrame:
    """Number of agents and plain means of their rates, missing ones left out."""
    return scorecard.selectExpr(
        "count(*) AS agents", "avg(net_conv) AS avg_net_conv",
        "avg(rev_per_call) AS avg_rev_per_call", "avg(talk_time) AS avg_talk_time")


def show_roster(summary: DataFrame) -> DataFrame:
    """Display texts of the roster summary."""
    return summary.selectExpr(
        f"{formats.or_missing(formats.as_count('agents'))} AS agents",
        f"{formats.or_missing(formats.as_pct('avg_net_conv'))} AS avg_net_conv",
        f"{formats.or_missing(formats.as_dollars('avg_rev_per_call'))} AS avg_rev_per_call",
        formats.or_missing(f"concat({formats.as_decimal('avg_talk_time', 1)}, ' min')") + " AS avg_talk_time",
    )


def agent_distribution(
    scorecard: DataFrame, measures: tuple[str, ...] = ("net_conv", "rev_per_call"), bins: int = BINS
) -> DataFrame:
    """Histogram of agents: equal-width bins from the smallest to the largest
    value of each measure. Empty bins have no row; if all agents have the same
    value there is one bin."""
    pairs = ", ".join(f"struct('{c}' AS measure, {c} AS x)" for c in measures)
    values = scorecard.selectExpr(f"inline(array({pairs}))").filter("x IS NOT NULL")
    # one row per measure name, so this side is always tiny
    span = F.broadcast(values.groupBy("measure").agg(F.expr("min(x) AS low"), F.expr("max(x) AS high")))
    return (
        values.join(span, "measure")
        .selectExpr(
            "measure", "low", f"(high - low) / {bins} AS width",
            f"CAST(if(low = high, 1, least(width_bucket(x, low, high, {bins}), {bins})) AS INT) AS bin")
        .groupBy("measure", "bin", "low", "width").agg(F.expr("count(*) AS agents"))
        .selectExpr("measure", "bin", "low + (bin - 1) * width AS bin_from", "low + bin * width AS bin_to", "agents")
        .orderBy("measure", "bin")
    )
