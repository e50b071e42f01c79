"""Overview reports: totals, funnel, week cards, period comparison, trend, snapshot.

Each takes call-mart rows, or a daily rollup of them, already restricted to the
wanted population, and reads them once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from dialtone.functions import formats
from dialtone.functions.periods import period_label, period_start
from dialtone.functions.rates import pct_change, total
from dialtone.operators import metrics as m
from dialtone.operators.filters import CALL_GROUPS
from dialtone.operators.measures import PREFIX, current_measures, summarise
from dialtone.sources.storage import staged

DAY = "call_date_est"
OVERALL = "Overall"


def kpi_totals(calls: DataFrame) -> DataFrame:
    """One row with all fifteen KPIs."""
    return m.wide(summarise(calls), m.TOTALS)


def _by_period(calls: DataFrame, granularity: str, *keys: str) -> DataFrame:
    return summarise(
        calls.filter(f"{DAY} IS NOT NULL"), period_start(DAY, granularity) + " AS period", *keys)


def funnel(calls: DataFrame, granularity: str = "Daily") -> DataFrame:
    """Funnel metrics as columns, one row per period."""
    return m.wide(_by_period(calls, granularity), m.FUNNEL, "period")


def funnel_long(calls: DataFrame, granularity: str = "Daily") -> DataFrame:
    """Funnel metrics as rows (period, position, metric, kind, value, label, shown)."""
    return m.long(_by_period(calls, granularity), m.FUNNEL, "period").selectExpr(
        "*", period_label("period", granularity) + " AS label",
        formats.display("value", "kind") + " AS shown",
    ).orderBy("position", "period")


def funnel_table(
    calls: DataFrame, granularity: str = "Daily", periods: Sequence[date] | None = None,
    shown: bool = False,
) -> DataFrame:
    """Metrics as rows and periods as columns named by their first day.

    Without ``periods`` the metrics of all periods are written to the shared
    folder first, and the columns are found there: the calls are read once.
    ``shown`` fills the cells with display texts.
    """
    cell = formats.display("value", "kind") if shown else "value"
    rows = m.long(_by_period(calls, granularity), m.FUNNEL, "period").selectExpr(
        "position", "metric", "date_format(period, 'yyyy-MM-dd') AS period", f"{cell} AS cell")
    if periods is None:
        rows = staged(rows, "funnel")  # a row per metric and period
    columns = None if periods is None else [p.isoformat() for p in periods]
    return rows.groupBy("position", "metric").pivot("period", columns).agg(F.expr("first(cell)")).orderBy("position")


def week_cards(calls: DataFrame) -> DataFrame:
    """Five KPIs of the latest week with data and of the one before it.

    "Before" is the previous week that has calls, not the previous on the
    calendar; with one week only its values are NULL.
    """
    weekly = m.long(_by_period(calls, "Weekly"), m.WEEK_CARDS, "period")
    # a handful of weeks per metric, whatever the number of calls
    ranked = weekly.selectExpr(
        "*", "row_number() OVER (PARTITION BY metric ORDER BY period DESC) AS age").filter("age <= 2")
    cards = ranked.groupBy("position", "metric", "kind").agg(
        F.expr("max(period) FILTER (WHERE age = 1) AS week"),
        F.expr("max(period) FILTER (WHERE age = 2) AS prior_week"),
        F.expr("max(value) FILTER (WHERE age = 1) AS value"),
        F.expr("max(value) FILTER (WHERE age = 2) AS prior_value"),
    )
    return cards.selectExpr("*", pct_change("prior_value", "value") + " AS change_pct").orderBy("position")


def show_week_cards(cards: DataFrame) -> DataFrame:
    """Display texts of the week cards; a value of zero shows as missing."""
    text = f"""CASE WHEN value = 0 THEN NULL WHEN kind = 'dollar' THEN {formats.as_dollars('value')}
        WHEN kind = 'pct' THEN {formats.as_pct('value')} ELSE concat({formats.as_decimal('value', 1)}, ' min') END"""
    return cards.selectExpr(
        "position", "metric", formats.or_missing(text) + " AS shown",
        f"concat({formats.as_signed_pct('change_pct')}, ' vs prior wk') AS delta")


def compare_periods(
    calls: DataFrame,
    first: Sequence[date | Column], second: Sequence[date | Column],
) -> DataFrame:
    """Funnel metrics of two periods side by side and their change in percent.

    The periods may overlap; a call may count in both. Bounds are dates or
    scalar subqueries, and the ends of a period may be swapped.
    """
    by_month = "call_month" in calls.columns

    def inside(bounds: Sequence[date | Column]) -> Column:
        if len(bounds) != 2:
            return F.lit(False)
        ends = [b if isinstance(b, Column) else F.lit(b) for b in bounds]
        low, high = F.least(*ends), F.greatest(*ends)
        chosen = F.col(DAY).between(low, high)
        if by_month:
            # lets a mart partitioned by month skip the other months
            chosen = chosen & F.col("call_month").between(
                F.date_format(low, "yyyy-MM"), F.date_format(high, "yyyy-MM"))
        return chosen

    measures = current_measures(calls)
    sides = ("first", "second")
    tagged = calls.withColumns({"_first": inside(first), "_second": inside(second)})
    summed = tagged.filter("_first OR _second").agg(*[
        F.expr(f"{total(f'CASE WHEN _{side} THEN {x} END')} AS {side}_{n}")
        for side in sides for n, x in measures.items()
    ])
    # one row unfolded into one per period, so the metrics are written once
    per_side = ", ".join(
        f"struct('{side}' AS side, " + ", ".join(f"{side}_{n} AS {PREFIX}{n}" for n in measures) + ")"
        for side in sides)
    rows = m.long(summed.selectExpr(f"inline(array({per_side}))"), m.FUNNEL, "side")
    compared = rows.groupBy("position", "metric", "kind").agg(*[
        F.expr(f"max(value) FILTER (WHERE side = '{side}') AS {side}_value") for side in sides])
    return (
        compared.selectExpr("*", pct_change("first_value", "second_value") + " AS change_pct")
        .selectExpr("*", formats.change_class("metric", "change_pct") + " AS change_class")
        .orderBy("position")
    )


def show_comparison(compared: DataFrame) -> DataFrame:
    """Display texts of a period comparison."""
    return compared.selectExpr(
        "position", "metric",
        formats.display("first_value", "kind") + " AS first_shown",
        formats.display("second_value", "kind") + " AS second_shown",
        formats.or_missing(formats.as_signed_pct("change_pct")) + " AS change_shown",
        "change_class",
    )


def _with_overall(per_group: DataFrame, group_by: str, *keys: str) -> DataFrame:
    """Rows per group and one "overall" row per ``keys``, from the grouped sums.

    Calls without a value of the dimension count in the overall row only.
    """
    sums = [F.expr(f"sum({c}) AS {c}") for c in per_group.columns if c.startswith(PREFIX)]
    both = per_group.groupingSets([[*keys, group_by], [*keys]], *keys, group_by).agg(
        *sums, F.expr(f"grouping({group_by}) = 1 AS is_overall"))
    return both.filter(f"is_overall OR {group_by} IS NOT NULL").selectExpr(
        "*", f"if(is_overall, '{OVERALL}', CAST({group_by} AS STRING)) AS series")


def trend(
    calls: DataFrame, granularity: str = "Daily", metrics: Iterable[str] | None = None,
    group_by: str | None = None,
) -> DataFrame:
    """Metric values over time as rows, overall and per value of a dimension.

    ``group_by`` is a column or the name it has for users.
    """
    registry, group_by = m.trend_of(calls.columns, m.chosen(m.TREND, metrics)), CALL_GROUPS.get(group_by, group_by)
    if group_by is None or group_by not in calls.columns:
        rows = _by_period(calls, granularity).selectExpr("*", f"'{OVERALL}' AS series", "true AS is_overall")
    else:
        rows = _with_overall(_by_period(calls, granularity, group_by), group_by, "period")
    return (
        m.long(rows, registry, "series", "is_overall", "period")
        .selectExpr("*", period_label("period", granularity) + " AS label")
        .orderBy("position", "is_overall", "series", "period")
    )


def snapshot(
    calls: DataFrame, metrics: Iterable[str] | None = None, group_by: str | None = None
) -> DataFrame:
    """One value per category over the whole range, best first, missing last."""
    registry, group_by = m.trend_of(calls.columns, m.chosen(m.TREND, metrics)), CALL_GROUPS.get(group_by, group_by)
    dated = calls.filter(f"{DAY} IS NOT NULL")
    if group_by is None or group_by not in calls.columns:
        rows = summarise(dated).selectExpr("*", f"'{OVERALL}' AS category")
    else:
        rows = summarise(
            dated.filter(f"{group_by} IS NOT NULL"), f"CAST({group_by} AS STRING) AS category")
    return m.long(rows, registry, "category").orderBy(
        "position", F.col("value").desc_nulls_last(), "category")


def show_snapshot(snapped: DataFrame) -> DataFrame:
    """Display texts of a snapshot: whole dollars, minutes with one decimal."""
    text = f"""CASE kind WHEN 'pct' THEN {formats.as_pct('value')} WHEN 'dollar' THEN {formats.as_dollars('value', 0)}
        WHEN 'decimal' THEN {formats.as_decimal('value', 1)} ELSE {formats.as_count('value')} END"""
    return snapped.selectExpr("category", "metric", formats.or_missing(text) + " AS shown")
