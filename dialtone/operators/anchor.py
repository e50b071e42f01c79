"""Latest qualifying earlier call of the same agent (an as-of match).

A call of at most ``cutoff`` seconds is matched to the agent's latest long call
that did not start after it. Done as a join this compares every short call of
an agent with every long one. Here it is a running maximum over time instead,
in four steps none of which needs an agent's calls in one task:

1. calls are reduced to one row per agent and start time (map-side combine
   first, so any number of calls at one instant is one row);
2. the running latest long time is taken inside (agent, time bucket);
3. each bucket's latest long time is carried forward over the agent's later
   buckets, where the number of buckets is bounded by the calendar;
4. the short calls look their start time up.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from dialtone.config import SHORT_CALL_SECONDS

# What becomes of long calls of an agent that start together.
TIES = ("all", "one")


def _bucket(calls: DataFrame, at: str, seconds: int) -> str:
    """Number of the time bucket; never falls while ``at`` rises."""
    if calls.schema[at].dataType.typeName() == "timestamp":
        return f"bigint(floor(unix_micros({at}) / {seconds * 1_000_000}))"
    # wall-clock times must not pass through a time zone
    clock = f"bigint(datediff({at}, DATE '1970-01-01')) * 86400 + hour({at}) * 3600 + minute({at}) * 60 + second({at})"
    return f"bigint(floor(({clock}) / {seconds}))"


_BEFORE_ALL = "-9223372036854775807L"


def _state(carried: Iterable[str], at: str = "anchor_at") -> str:
    return "struct(" + ", ".join([f"{at} AS anchor_at", *carried]) + ")"


def _timeline(
    calls: DataFrame, agent: str, at: str, talk: str, cutoff: int,
    bucket_seconds: int, carried: Mapping[str, str], combine: str, before: DataFrame | None = None,
) -> DataFrame:
    """One row per agent and instant with the anchor as of that instant.

    Columns: agent, at, anchor_at and, combined (``sum`` or ``min``) over the
    long calls that start at anchor_at, one column per entry of ``carried``.
    ``before`` has the same columns but at: the anchor of each agent before the
    first of the calls, which is carried forward like that of a bucket.
    """
    is_long = f"{talk} > {cutoff}"
    instants = (
        calls.filter(f"{agent} IS NOT NULL AND {at} IS NOT NULL AND {talk} IS NOT NULL")
        .groupBy(agent, F.expr(f"{_bucket(calls, at, bucket_seconds)} AS _bucket"), at)
        .agg(
            F.expr(f"max({is_long}) AS _has_long"),
            *[F.expr(f"{combine}(CASE WHEN {is_long} THEN {x} END) AS {n}") for n, x in carried.items()],
        )
    )
    state = _state(carried, at)
    local = instants.selectExpr(
        agent, "_bucket", at,
        f"""last(CASE WHEN _has_long THEN {state} END, true) OVER (
            PARTITION BY {agent}, _bucket ORDER BY {at}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _local""",
    )
    latest = local.groupBy(agent, "_bucket").agg(F.expr("max(_local) AS _latest"))
    if before is not None:
        latest = latest.unionByName(before.selectExpr(agent, f"{_BEFORE_ALL} AS _bucket", f"{_state(carried)} AS _latest"))
    carry = latest.selectExpr(
        agent, "_bucket",
        f"""last(_latest, true) OVER (
            PARTITION BY {agent} ORDER BY _bucket
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _carry""",
    )
    # a left join, although no bucket lacks its carry: it puts no extra filter on
    # one side, so both sides keep the same plan and share one shuffle
    return (
        local.join(carry, [agent, "_bucket"], "left")
        .selectExpr(agent, at, "coalesce(_local, _carry) AS _anchor")
        .selectExpr(agent, at, "_anchor.*")
    )


def anchor_times(
    calls: DataFrame, *, key: str = "call_id", agent: str = "employeeid",
    at: str = "call_datetime_est", talk: str = "talk_time_seconds",
    cutoff: int = SHORT_CALL_SECONDS, bucket_seconds: int = 3600,
    carried: Mapping[str, str] | None = None, combine: str = "sum", before: DataFrame | None = None,
) -> DataFrame:
    """(short_call_id, anchor_at, carried...) for short calls with an anchor.

    ``before`` (agent, anchor_at, carried...) gives the anchors of agents as of
    before the calls, one row an agent.
    """
    carried = dict(carried or {})
    timeline = _timeline(calls, agent, at, talk, cutoff, bucket_seconds, carried, combine, before)
    # the id hangs on the talk time, so that filters on it stay above the input
    # and do not keep its two readers from sharing a shuffle
    short = calls.selectExpr(
        f"CASE WHEN {talk} <= {cutoff} THEN {key} END AS short_call_id", agent, at
    ).filter("short_call_id IS NOT NULL")
    return (
        short.join(timeline.filter("anchor_at IS NOT NULL"), [agent, at])
        .select("short_call_id", agent, "anchor_at", *carried)
    )


def last_of_days(
    calls: DataFrame, carried: Mapping[str, str], *, agent: str = "employeeid", at: str = "call_datetime_est",
    talk: str = "talk_time_seconds", cutoff: int = SHORT_CALL_SECONDS,
) -> DataFrame:
    """(agent, day, anchor_at, carried...): the last instant of each agent and day at which a long call started.

    ``carried`` names aggregations over the long calls of that instant.
    """
    longs = calls.filter(f"{talk} > {cutoff} AND {agent} IS NOT NULL AND {at} IS NOT NULL")
    instants = longs.groupBy(agent, at).agg(*[F.expr(f"{x} AS {n}") for n, x in carried.items()])
    days = instants.groupBy(agent, F.expr(f"CAST({at} AS DATE) AS day")).agg(F.expr(f"max({_state(carried, at)}) AS _last"))
    return days.selectExpr(agent, "day", "_last.*")


def anchor_classes(
    calls: DataFrame, *, key: str = "call_id", agent: str = "employeeid",
    at: str = "call_datetime_est", talk: str = "talk_time_seconds", cutoff: int = SHORT_CALL_SECONDS, **options,
) -> DataFrame:
    """Tied anchors as classes: one row for each short call with an anchor and for each long call that is one.

    A class is an agent and an instant; it is named by its smallest long call. Columns: class, agent, anchor_at,
    call_id, is_anchor. The pairs of `anchor_calls` are the anchors of a class with its other members.
    """
    smallest = {"class": key}
    short = anchor_times(calls, key=key, agent=agent, at=at, talk=talk, cutoff=cutoff, carried=smallest, combine="min", **options)
    used = short.select(agent, "anchor_at", "class").distinct()
    longs = calls.filter(f"{talk} > {cutoff}").selectExpr(agent, f"{at} AS anchor_at", f"{key} AS call_id")
    return short.selectExpr("class", agent, "anchor_at", "short_call_id AS call_id", "false AS is_anchor").unionByName(
        longs.join(used, [agent, "anchor_at"]).selectExpr("class", agent, "anchor_at", "call_id", "true AS is_anchor"))


def pairs_of_classes(classes: DataFrame) -> DataFrame:
    """(short_call_id, anchor_call_id) of the classes, as many rows as tied anchors times short calls."""
    members = classes.filter("NOT is_anchor").selectExpr("class", "call_id AS short_call_id")
    return members.join(classes.filter("is_anchor").selectExpr("class", "call_id AS anchor_call_id"), "class").select(
        "short_call_id", "anchor_call_id")


def latest_prior_long_call(calls: DataFrame, **columns) -> DataFrame:
    """(short_call_id, anchor_at): when the anchor of each short call started."""
    return anchor_times(calls, **columns).select("short_call_id", "anchor_at")


def anchor_calls(
    calls: DataFrame, *, key: str = "call_id", agent: str = "employeeid",
    at: str = "call_datetime_est", talk: str = "talk_time_seconds",
    cutoff: int = SHORT_CALL_SECONDS, ties: str = "all", **options,
) -> DataFrame:
    """(short_call_id, anchor_call_id): the long calls at the anchor time.

    With ``ties="all"`` calls of one agent that start together all count as the
    anchor, so a short call may appear several times: as many rows as tied long
    calls times short ones. ``ties="one"`` takes the smallest id of them.
    """
    if ties not in TIES:
        raise ValueError(f"ties is one of {TIES}")
    if ties == "one":
        smallest = {"anchor_call_id": key}
        return anchor_times(
            calls, key=key, agent=agent, at=at, talk=talk, cutoff=cutoff, carried=smallest, combine="min", **options,
        ).select("short_call_id", "anchor_call_id")
    times = anchor_times(calls, key=key, agent=agent, at=at, talk=talk, cutoff=cutoff, **options)
    longs = calls.filter(f"{talk} > {cutoff}").selectExpr(
        agent, f"{at} AS anchor_at", f"{key} AS anchor_call_id")
    return times.join(longs, [agent, "anchor_at"]).select("short_call_id", "anchor_call_id")
