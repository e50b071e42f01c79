"""The call mart: one row per call, with 28 columns.

All joins by call share one hash partitioning of the deduplicated calls, so the
wide rows are shuffled once. The anchor match, which needs calls by agent, runs
on four narrow columns and comes back as two counts per short call.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from dialtone import config as fixed
from dialtone.config import ExtractConfig
from dialtone.functions.periods import period_start, weekday_name
from dialtone.operators import classify, filters, lookups
from dialtone.operators.anchor import anchor_times, last_of_days
from dialtone.operators.dedup import latest_version, uniqueness_report
from dialtone.operators.order_rollup import order_rollup, orders_since


@dataclass(frozen=True)
class Sources:
    """Input tables of the extract."""

    agent_calls: DataFrame
    sessions: DataFrame
    orders: DataFrame
    agents: DataFrame
    marketing: DataFrame
    calls: DataFrame
    intents: DataFrame


# Order of call versions of equal time. What else a version holds comes after it,
# so a dedup of these columns alone picks versions that agree in them.
TIE_BREAK = ("talk_time_seconds", "employeeid")


def scoped_calls(src: Sources, cfg: ExtractConfig, lower: date | None = None) -> DataFrame:
    """Call versions inside the extract's scope, or from ``lower`` on."""
    recent = filters.since(src.agent_calls, "call_datetime_est", lower or cfg.from_date)
    return filters.not_excluded(recent, "conversion_exclude_ind")


def deduplicated_calls(scoped: DataFrame) -> DataFrame:
    """The newest version of each call."""
    others = sorted(set(scoped.columns) - {"call_id", "call_datetime_est", *TIE_BREAK})
    content = F.expr(f"xxhash64({', '.join(others)})")
    return latest_version(scoped, "call_id", "call_datetime_est", [*TIE_BREAK, content])


def registered_calls(src: Sources, cfg: ExtractConfig, lower: date | None = None) -> DataFrame:
    """Distinct calls of the session registry."""
    recent = filters.since(src.sessions, "session_start_date", cfg.related_from or lower or cfg.from_date)
    return recent.select("call_id").filter("call_id is not null").distinct()


ANCHOR_COLUMNS = ("call_id", "call_datetime_est", "employeeid", "talk_time_seconds")


def _newest_narrow(scoped: DataFrame) -> DataFrame:
    """The newest version of each call in the columns of the anchor match. A reading of its own: four columns of the
    source and their shuffle are less than a second look at the wide rows in the shuffle of the calls."""
    return latest_version(scoped.select(*ANCHOR_COLUMNS), "call_id", "call_datetime_est", TIE_BREAK)


def anchor_membership(
    newest: DataFrame, registered: DataFrame, cfg: ExtractConfig, before: DataFrame | None = None
) -> DataFrame:
    """Per short call with an anchor: how many of the anchor's calls are
    registered and how many are not.

    ``before`` holds the last long call of each agent before the calls, as `membership_state` describes it.
    """
    flagged = lookups.member_flag(newest, registered, "call_id", "registered")
    if cfg.anchor_ties == "one":
        # the tied call of the smallest id, and whether it is registered
        return anchor_times(
            flagged, bucket_seconds=cfg.anchor_bucket_seconds, combine="min",
            carried={"smallest": "struct(call_id, registered)"}, before=before,
        ).selectExpr(
            "short_call_id AS call_id", "int(smallest.registered) AS registered_anchors",
            "int(NOT smallest.registered) AS other_anchors")
    return anchor_times(
        flagged,
        bucket_seconds=cfg.anchor_bucket_seconds,
        carried={
            "registered_anchors": "int(registered)",
            "other_anchors": "int(NOT registered)",
        },
        before=before,
    ).selectExpr("short_call_id AS call_id", "registered_anchors", "other_anchors")


def membership_state(newest: DataFrame, registered: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """(employeeid, day, anchor_at, registered_anchors, other_anchors, smallest): of each agent and day the last
    instant of a long call, how many of the long calls there are registered, and the one of the smallest id."""
    flagged = lookups.member_flag(newest.select(*ANCHOR_COLUMNS), registered, "call_id", "registered")
    return last_of_days(flagged, {
        "registered_anchors": "sum(int(registered))", "other_anchors": "sum(int(NOT registered))",
        "smallest": "min(struct(call_id, registered))",
    })


def call_mart(
    src: Sources, cfg: ExtractConfig, calls: DataFrame | None = None, carried: DataFrame | None = None
) -> DataFrame:
    """The call mart in no particular order.

    ``calls`` may hold the newest versions of the calls, written to shared
    storage, when reading the source twice costs more than that. ``carried`` is
    the state of each agent as of ``from_date``, in place of a look at older facts.
    """
    scoped, registered, labels = scoped_calls(src, cfg), registered_calls(src, cfg), cfg.labels
    newest = deduplicated_calls(scoped) if calls is None else calls
    narrow = _newest_narrow(scoped) if calls is None else calls.select(*ANCHOR_COLUMNS)
    if carried is None and cfg.anchor_from is not None:
        lower = min(cfg.anchor_from, cfg.from_date)
        anchors = anchor_membership(_newest_narrow(scoped_calls(src, cfg, lower)), registered_calls(src, cfg, lower), cfg)
    else:
        anchors = anchor_membership(narrow, registered, cfg, carried)
    calls = lookups.member_flag(newest, registered, "call_id", "registered")
    calls = lookups.attach(calls, anchors, "call_id")
    # order lines of calls out of scope find no call here, so they need no
    # semi-join of their own, which would read and shuffle the calls once more
    calls = lookups.attach(
        calls,
        order_rollup(orders_since(src.orders, cfg.related_from or cfg.from_date, cfg.order_time_zone), cfg.prepaid_product),
        "call_id",
    )
    calls = lookups.attach(
        calls,
        lookups.counted_values(
            src.calls, "call_id",
            classify.call_type("permalease_call_ind", "remote_number_call", cfg.non_lease_numbers),
            classify.CALL_TYPES, "call_types",
        ),
        "call_id",
    )
    calls = lookups.attach(
        calls,
        lookups.counted_values(
            src.intents, "call_id", F.expr(classify.mover_switcher("movingSwitchingExtracted")),
            classify.INTENTS, "intents",
        ),
        "call_id",
    )
    calls = lookups.attach(
        calls,
        lookups.counted(src.agents, {"employeeid": "employeeid"}, {"employee_name": "employee_name"}, "agent_copies"),
        "employeeid",
    )
    calls = lookups.attach(
        calls.selectExpr("*", "coalesce(marketing_code_id, 0) AS mcid"),
        lookups.counted(src.marketing, {"mcid": "mcid"}, {"bucket": "marketing_bucket"}, "bucket_copies"),
        "mcid",
    )

    calls = calls.filter(
        filters.name_allowed(F.expr("coalesce(agent_name, employee_name)"), cfg.excluded_agents)
        & filters.center_allowed(F.col("center_location"), cfg.excluded_centers)
    )

    # A short call takes the membership of its anchor, once per anchor call.
    calls = calls.selectExpr(
        "*",
        f"coalesce(talk_time_seconds <= {fixed.SHORT_CALL_SECONDS}, false) AS is_short",
    ).selectExpr(
        "*",
        "CASE WHEN NOT is_short THEN int(registered) ELSE coalesce(registered_anchors, 0) END AS treatment_copies",
        "CASE WHEN NOT is_short THEN int(NOT registered) ELSE coalesce(other_anchors, 1) END AS control_copies",
    ).selectExpr(
        "*",
        "inline(array(struct(true AS treated, treatment_copies AS copies),"
        " struct(false AS treated, control_copies AS copies)))",
    ).filter("copies > 0")
    calls = lookups.unfolded(calls, "call_types", classify.CALL_TYPES, "call_type", "call_copies")
    calls = lookups.unfolded(calls, "intents", classify.INTENTS, "moverSwitcher", "intent_copies")
    lookup_copies = [f"coalesce({c}, 1)" for c in ("call_copies", "intent_copies", "agent_copies", "bucket_copies")]
    calls = lookups.repeat_rows(calls, " * ".join(["copies", *lookup_copies]))

    passed, credit, sold = "passed_credit_call_ind", "credit_calls_ind", "credit_sold_calls_ind"
    day, talked = "call_date_est", classify.minutes("talk_time_seconds")
    membership = F.when(F.col("treated"), labels.treatment).otherwise(labels.control)
    return calls.withColumns({
        "call_date_est": F.expr("CAST(call_datetime_est AS DATE)"),
        "orders": F.expr("coalesce(order_count, 0)"),
        "membership": membership,
    }).selectExpr(
        "call_id",
        "call_datetime_est AS call_time_est",
        day,
        period_start(day, "Weekly") + " AS week_start",
        period_start(day, "Monthly") + " AS month_start",
        "pc",
        weekday_name(day) + " AS day_of_week",
        classify.tenure_bucket("hire_date", day) + " AS tenure_bucket",
        f"coalesce(bucket, '{fixed.BUCKET_OTHER}') AS marketing_bucket",
        f"coalesce(call_type, '{fixed.CALL_TYPE_SITE}') AS call_type",
        f"coalesce(call_direction, '{fixed.UNKNOWN}') AS call_direction",
        "membership",
        "coalesce(agent_name, employee_name) AS agent_name",
        f"coalesce(center_location, '{fixed.UNKNOWN}') AS center_location",
        f"coalesce(moverSwitcher, '{fixed.INTENT_NONE}') AS moverSwitcher",
        "coalesce(ib_contact_calls, 0) AS ib_contact_calls",
        f"coalesce({credit}, 0) AS credit_calls_flag",
        classify.passed_credit_call(passed, credit) + " AS passed_credit_call_flag",
        classify.failed_credit_call(passed, credit) + " AS failed_credit_call_flag",
        classify.passed_credit_sale(sold, passed) + " AS passed_credit_sale_flag",
        classify.failed_credit_sale(sold, passed, "orders") + " AS failed_credit_sale_flag",
        "orders",
        "CAST(coalesce(order_value, 0) AS DECIMAL(28,8)) AS gcv_fo",
        "CAST(coalesce(order_value, 0) AS DECIMAL(28,8)) AS total_revenue",
        f"{talked} AS talk_time_minutes",
        f"CASE WHEN orders > 0 THEN {talked} END AS talk_time_minutes_sold",
        f"CASE WHEN orders = 0 THEN {talked} END AS talk_time_minutes_unsold",
        classify.top_product(day, "total_points", "has_prepaid") + " AS tpsales_flag",
    )


def newest_first(mart: DataFrame) -> DataFrame:
    """Presentation order of the call mart; not needed to write it.

    The call id orders calls of one instant, so that even very many of them
    spread over several sort partitions.
    """
    return mart.orderBy(F.col("call_time_est").desc(), "call_id")


def lookup_uniqueness(src: Sources) -> DataFrame:
    """Which lookups of the extract would multiply calls, and by how much."""
    return uniqueness_report({
        "agents": (src.agents, "employeeid"),
        "marketing": (src.marketing, "mcid"),
        "calls": (src.calls, "call_id"),
        "intents": (src.intents, "call_id"),
    })
