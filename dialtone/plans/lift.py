"""Treatment-versus-control lift, before and after a launch.

Facts come in three periods: ``post`` rows belong to a week, ``pre_weekly`` rows
are the baseline of the post week they name, and ``pre`` rows are the fixed
baseline. Cohorts are given with the facts. Week labels stay the texts they are;
only the trend, which needs an axis, reads them as dates.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, functions as F

from dialtone.config import CallFilters, Labels, LiftWindow
from dialtone.functions import formats
from dialtone.functions.rates import relative_delta, weighted_average
from dialtone.operators import filters, metrics as m
from dialtone.operators.measures import summarise_lift

WEEK_PATTERN = "M/d/yyyy"
CELLS = ("pre_treatment", "pre_control", "post_treatment", "post_control")
AVERAGED = (
    "pre_treatment", "pre_control", "pre_delta",
    "post_treatment", "post_control", "post_delta", "swing",
)
VIEWS = ("raw", "post_delta", "swing")


def post_bounds(lift: DataFrame) -> DataFrame:
    """One row: first and last day with post rows."""
    return filters.day_bounds(lift.filter("period = 'post'"), "call_datetime_est")


def active_weeks(lift: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Weeks that have post rows inside the window."""
    post = filters.between_days(lift.filter("period = 'post'"), "call_datetime_est", start, end)
    return post.select("week").filter("week is not null").distinct()


def baseline_of(lift: DataFrame, weeks: DataFrame) -> DataFrame:
    """Weekly baseline rows of the given post weeks."""
    return lift.filter("period = 'pre_weekly'").join(
        weeks.select(F.col("week").alias("post_week")), "post_week", "left_semi")


def weekly_scope(
    lift: DataFrame, window: LiftWindow | None = None, selected: CallFilters = CallFilters()
) -> DataFrame:
    """Post rows in the window and all weekly baselines, as selected.

    ``week_key``, which a table has and which is added otherwise, is the post week a row counts for. The baselines of weeks
    without post rows count nowhere. Where a window leaves weeks out, they are
    dropped before the aggregation, as baselines repeat for every post week and
    are most of the facts; without one they drop out when the cells of a week
    are compared, so the facts are read once.
    """
    is_post = F.col("period") == "post"
    rows = lift.filter(is_post | (F.col("period") == "pre_weekly"))
    if window is not None:
        rows = rows.filter(~is_post | filters.day_within(
            rows, "call_datetime_est", window.post_from, window.post_to))
    if "week_key" not in rows.columns:
        rows = rows.withColumn("week_key", F.when(is_post, F.col("week")).otherwise(F.col("post_week")))
    if window is not None and (window.post_from is not None or window.post_to is not None):
        # one row per week of the calendar: sent to all tasks, where the weeks also say which folders of a table to read
        active = F.broadcast(active_weeks(lift, window.post_from, window.post_to))
        rows = rows.join(active.select(F.col("week").alias("week_key")), "week_key", "left_semi").select(*rows.columns)
    rows = filters.without_value(rows, "week_key", window.excluded_week if window else None)
    return filters.assigned(filters.apply_lift_filters(rows, selected))


def fixed_baseline(
    lift: DataFrame, window: LiftWindow, selected: CallFilters = CallFilters()
) -> DataFrame:
    """Rows of the fixed baseline, by the cohort assigned to them for it."""
    rows = filters.between_days(
        lift.filter("period = 'pre'"), "call_datetime_est", window.pre_start, window.pre_end)
    rows = filters.without_value(filters.apply_lift_filters(rows, selected), "week", window.excluded_week)
    return filters.assigned(
        rows.drop("cohort").withColumnRenamed("canonical_cohort", "cohort"))


def lift_kpis(facts: DataFrame, *keys: str) -> DataFrame:
    """All thirteen lift KPIs as columns, one row per ``keys``."""
    return m.wide(summarise_lift(facts, *keys), {**m.LIFT_VOLUMES, **m.LIFT}, *keys)


def fixed_baseline_kpis(baseline: DataFrame, group_by: str | None = None) -> DataFrame:
    """Lift KPIs of the fixed baseline per cohort and, if wanted, dimension."""
    if group_by:
        baseline = baseline.filter(F.col(group_by).isNotNull())
    return lift_kpis(baseline, "cohort", *([group_by] if group_by else []))


def weekly_cohort_kpis(scope: DataFrame, group_by: str | None = None) -> DataFrame:
    """Lift KPIs of the post rows per week, cohort and, if wanted, dimension."""
    keys = ["week_key", "cohort", *([group_by] if group_by else [])]
    post = scope.filter("period = 'post'").na.drop(subset=keys)
    return lift_kpis(post, *keys).withColumnRenamed("week_key", "week")


def _cells(
    scope: DataFrame, labels: Labels, group_by: str | None, registry: m.Registry
) -> DataFrame:
    """Per week, dimension and KPI: the four cell values, which cells have rows,
    the deltas between them and the post inbound calls."""
    keys = ["week_key", *([group_by] if group_by else [])]
    known = scope.filter(F.col("cohort").isin(labels.treatment, labels.control)).na.drop(subset=keys)
    side = F.when(F.col("cohort") == labels.treatment, "treatment").otherwise("control")
    summed = summarise_lift(
        known.withColumn("cell", F.concat(F.expr("if(period = 'post', 'post_', 'pre_')"), side)), *keys, "cell")
    rows = m.long(summed, registry, *keys, "cell", "m_calls")
    return rows.groupBy(*keys, "position", "metric", "kind").agg(
        *[F.expr(f"max(value) FILTER (WHERE cell = '{c}') AS {c}") for c in CELLS],
        *[F.expr(f"count_if(cell = '{c}') > 0 AS has_{c}") for c in CELLS],
        F.expr("coalesce(sum(m_calls) FILTER (WHERE cell LIKE 'post%'), 0) AS weight"),
    ).selectExpr(
        "*", relative_delta("pre_treatment", "pre_control") + " AS pre_delta",
        relative_delta("post_treatment", "post_control") + " AS post_delta",
    ).selectExpr("*", "post_delta - pre_delta AS swing")


def weekly_lift(scope: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """One row per week and KPI for the weeks in which all four cells have rows.

    The weight of a week is its number of inbound post calls; it may be zero.
    """
    complete = " AND ".join("has_" + c for c in CELLS)
    return _cells(scope, labels, None, m.LIFT).filter(complete).selectExpr(
        "week_key AS week", "position", "metric", "kind", "weight", *AVERAGED)


def lift_volume(weekly: DataFrame) -> DataFrame:
    """One row: number of weeks compared and their total weight."""
    # every KPI repeats the weeks, so one of them is counted
    return weekly.filter("position = 1").selectExpr(
        "count(*) AS week_count", "coalesce(sum(weight), 0) AS total_weight")


def lift_summary(weekly: DataFrame) -> DataFrame:
    """Weighted averages over the weeks, one row per KPI.

    Each column leaves out the weeks where it is missing itself, so the average
    swing is not in general the difference of the average deltas.
    """
    averages = weekly.groupBy("metric").agg(
        *[F.expr(f"{weighted_average(c, 'weight')} AS {c}") for c in AVERAGED])
    # a KPI has its row even when no week could be compared
    every = ", ".join(
        f"struct({i} AS position, '{k}' AS metric, '{m.LIFT_NAMES[k]}' AS name, '{kpi.kind}' AS kind)"
        for i, (k, kpi) in enumerate(m.LIFT.items(), 1))
    kpis = weekly.sparkSession.range(1).selectExpr(f"inline(array({every}))")
    # one row per KPI, so this side is always tiny
    return kpis.join(F.broadcast(averages), "metric", "left").select(
        "position", "metric", "name", "kind", *AVERAGED).orderBy("position")


def lift_headlines(summary: DataFrame) -> DataFrame:
    """Swing and post delta of the five KPIs that head the report."""
    heads = ", ".join(f"'{k}'" for k in m.LIFT_HEADLINES)
    return (
        summary.filter(f"metric IN ({heads})")
        .selectExpr(f"CAST(array_position(array({heads}), metric) AS INT) AS position", "metric", "swing", "post_delta")
        .orderBy("position")
    )


def show_headlines(headlines: DataFrame) -> DataFrame:
    """Display texts of the headline swings."""
    swing, post = formats.as_points("swing", "pp"), formats.as_points("post_delta", "pp")
    return headlines.selectExpr(
        "position", "metric",
        formats.or_missing(f"concat({swing}, ' swing')") + " AS swing_shown",
        f"if(swing IS NULL, NULL, concat('Post Δ: ', {post})) AS post_shown")


def show_summary(summary: DataFrame) -> DataFrame:
    """Display texts of the summary table and the class of each delta."""
    deltas = ("pre_delta", "post_delta", "swing")
    texts = [
        (formats.or_missing(formats.as_points(c)) if c in deltas else formats.display(c, "kind", dollar_places=1))
        + f" AS {c}_shown"
        for c in AVERAGED
    ]
    classes = [formats.change_class("metric", f"({c} * 100)") + f" AS {c}_class" for c in deltas]
    return summary.selectExpr("position", "name", *texts, *classes)


def lift_trend(
    scope: DataFrame, view: str = "raw", metrics: Iterable[str] | None = None,
    group_by: str | None = None, labels: Labels = Labels(),
) -> DataFrame:
    """Weekly series of the lift KPIs: (series, group, week_start, metric, value).

    ``raw`` has both cohorts, ``post_delta`` the treatment's distance from
    control, ``swing`` how far that moved from the week's baseline. A point
    exists where the post cell has rows; a missing counterpart makes it NULL.
    """
    group_by = filters.LIFT_GROUPS.get(group_by, group_by)
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}; one of {', '.join(VIEWS)}")
    if view != "swing":
        scope = scope.filter("period = 'post'")
    cells = _cells(scope, labels, group_by, m.chosen(m.LIFT, metrics))
    treatment = "post_treatment" if view == "raw" else view
    points = [f"struct('treatment' AS side, has_post_treatment AS present, {treatment} AS value)"]
    if view == "raw":
        points.append("struct('control' AS side, has_post_control AS present, post_control AS value)")
    cohort = F.when(F.col("side") == "treatment", labels.treatment).otherwise(labels.control)
    return (
        cells.selectExpr(
            f"CAST({group_by or 'NULL'} AS STRING) AS group_value",
            f"CAST(try_to_timestamp(week_key, '{WEEK_PATTERN}') AS DATE) AS week_start",
            "position", "metric", "kind", f"inline(array({', '.join(points)}))")
        .filter("present AND week_start IS NOT NULL")
        .withColumn("cohort", cohort)
        .selectExpr("concat_ws(' — ', group_value, cohort) AS series", "group_value", "cohort",
                    "week_start", "position", "metric", "kind", "value")
        .orderBy("position", "group_value", "cohort", "week_start")
    )
