"""Row selections shared by the extract and the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from dialtone.config import CallFilters, Labels

# The filterable dimensions of the call mart and of the lift facts.
CALL_DIMENSIONS = {
    "center_location": "center_location",
    "marketing_bucket": "marketing_bucket",
    "mover_switcher": "moverSwitcher",
    "tenure_bucket": "tenure_bucket",
    "call_type": "call_type",
}
LIFT_DIMENSIONS = {
    "marketing_bucket": "marketing_bucket",
    "mover_switcher": "mover_switcher",
    "tenure_bucket": "tenure_bucket",
    "call_type": "call_type",
}

# The names under which users pick a dimension to group by.
CALL_GROUPS = {
    "Center": "center_location",
    "Marketing Bucket": "marketing_bucket",
    "Mover / Switcher": "moverSwitcher",
    "Tenure Bucket": "tenure_bucket",
    "Call Type": "call_type",
    "None (Overall)": None,
}
LIFT_GROUPS = {
    "None (Overall)": None,
    "Marketing Bucket": "marketing_bucket",
    "Mover / Switcher": "mover_switcher",
    "Tenure Bucket": "tenure_bucket",
    "Call Type": "call_type",
}


def since(df: DataFrame, column: str, lower: date) -> DataFrame:
    """Lower bound; a plain literal comparison, so it reaches the file scan.

    A TIMESTAMP or TIMESTAMP_NTZ column is compared with midnight of the day.
    """
    kind = df.schema[column].dataType.typeName()
    return df.filter(F.col(column) >= F.lit(lower).cast(kind))


def not_excluded(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose exclusion flag is not set at all."""
    return df.filter(F.col(flag).isNull())


def name_allowed(name: Column, excluded: Sequence[str]) -> Column:
    """A name that is known and not excluded; an unknown one is dropped."""
    known = name.isNotNull()
    return known & ~name.isin(*excluded) if excluded else known


def center_allowed(center: Column, excluded: Sequence[str]) -> Column:
    """A centre that is not excluded; an unknown one is kept."""
    return ~F.coalesce(center, F.lit("")).isin(*excluded) if excluded else F.lit(True)


def treatment_only(df: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """Default population of the overview and agent reports."""
    if "membership" not in df.columns:
        return df
    return df.filter(F.col("membership") == labels.treatment)


def day_within(df: DataFrame, column: str, start: date | None, end: date | None) -> Column:
    """Whether the day of ``column`` lies in an inclusive, half-open or open range.

    Ends in the wrong order leave nothing. On a mart partitioned by month the
    condition also prunes partitions. Half-open ranges extend what the reports
    offer, where a range has both ends or none.
    """
    day = F.col(column)
    if df.schema[column].dataType.typeName() != "date":
        day = F.to_date(day)
    by_month = "call_month" in df.columns and column == "call_date_est"
    inside = F.lit(True)
    if start is not None:
        inside = inside & (day >= F.lit(start))
        if by_month:
            inside = inside & (F.col("call_month") >= f"{start:%Y-%m}")
    if end is not None:
        inside = inside & (day <= F.lit(end))
        if by_month:
            inside = inside & (F.col("call_month") <= f"{end:%Y-%m}")
    return inside


def between_days(df: DataFrame, column: str, start: date | None, end: date | None) -> DataFrame:
    """Rows whose day of ``column`` lies in the range."""
    return df.filter(day_within(df, column, start, end))


def period_slice(df: DataFrame, column: str, bounds: Sequence[date]) -> DataFrame:
    """Rows of a chosen period; an incompletely chosen period has none, and ends
    in the wrong order are swapped."""
    if len(bounds) != 2:
        return df.filter(F.lit(False))
    return between_days(df, column, min(bounds), max(bounds))


def any_of(df: DataFrame, selections: Mapping[str, Sequence[str]]) -> DataFrame:
    """Multi-select on several columns; no selection and no column, no filter."""
    for column, values in selections.items():
        if values and column in df.columns:
            df = df.filter(F.col(column).isin(*values))
    return df


def apply_call_filters(
    calls: DataFrame, filters: CallFilters, labels: Labels = Labels()
) -> DataFrame:
    """Population of an overview or agent report: treatment calls as selected."""
    calls = between_days(treatment_only(calls, labels), "call_date_est", filters.start, filters.end)
    return any_of(calls, {c: getattr(filters, f) for f, c in CALL_DIMENSIONS.items()})


def undated_calls(calls: DataFrame, filters: CallFilters, labels: Labels = Labels()) -> DataFrame:
    """Population of the week cards and of the period comparison, which choose their own days: the selections
    without the date range."""
    return apply_call_filters(calls, filters.without_dates(), labels)


def apply_lift_filters(lift: DataFrame, filters: CallFilters) -> DataFrame:
    """The same selections on lift facts, which are of one centre already."""
    return any_of(lift, {c: getattr(filters, f) for f, c in LIFT_DIMENSIONS.items()})


def name_matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Case-insensitive regular-expression search; missing names never match."""
    return df.filter(F.col(column).rlike("(?i)" + pattern)) if pattern else df


def without_value(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Drop one value of a column and keep the rows where it is missing."""
    return df if value is None else df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def assigned(df: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Rows that belong to a cohort."""
    return df.filter(F.col(cohort).isNotNull())


def day_bounds(df: DataFrame, column: str = "call_date_est") -> DataFrame:
    """One row: first and last day."""
    day = f"CAST({column} AS DATE)"
    return df.selectExpr(f"min({day}) AS first_day", f"max({day}) AS last_day")


def noted_bounds(days: DataFrame, labels: Labels = Labels()) -> DataFrame:
    """One row: first and last day of the treatment calls, from the notes on a written mart."""
    return treatment_only(days, labels).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def default_window(df: DataFrame, column: str = "call_date_est", bounds: DataFrame | None = None) -> DataFrame:
    """One row: the seven days that end at the last day, within the data.

    ``bounds`` (first_day, last_day), where they are known, spare the look at the data.
    """
    return (bounds or day_bounds(df, column)).selectExpr(
        "greatest(first_day, date_sub(last_day, 6)) AS window_start", "last_day AS window_end")


def default_comparison(df: DataFrame, column: str = "call_date_est", bounds: DataFrame | None = None) -> DataFrame:
    """One row: the last seven days (p2) and the seven days before them (p1).

    With too little data for an earlier week, p1 starts at the first day.
    """
    latest = (bounds or day_bounds(df, column)).selectExpr(
        "*", "greatest(first_day, date_sub(last_day, 6)) AS p2_start")
    return latest.selectExpr(
        "if(first_day < p2_start, greatest(first_day, date_sub(p2_start, 7)), first_day) AS p1_start",
        "if(first_day < p2_start, date_sub(p2_start, 1), least(last_day, date_add(first_day, 6))) AS p1_end",
        "p2_start",
        "last_day AS p2_end",
    )


def in_default_window(df: DataFrame, column: str = "call_date_est", bounds: DataFrame | None = None) -> DataFrame:
    """Rows of the default window, found by scalar subqueries in the same job.

    With ``bounds``, such as the notes on a written mart give, nothing but the months of the window is read. Without
    them, on a mart partitioned by month, the newest month that has days is found first, in a reading of the columns
    that ``df`` is filtered by; the rows are then taken from its month and the one before it.
    """
    day, by_month = F.to_date(column), "call_month" in df.columns and column == "call_date_est"
    if bounds is None and by_month:
        newest = df.select(F.max("call_month").alias("m")).select("m").scalar()
        # the first day of the data limits nothing here: no row lies before it
        last = df.filter(F.col("call_month") == newest).agg(F.max(day).alias("last_day"))
        window = last.selectExpr("date_sub(last_day, 6) AS window_start", "last_day AS window_end")
    else:
        window = default_window(df, column, bounds)
    start, end = (window.select(c).scalar() for c in ("window_start", "window_end"))
    inside = day.between(start, end)
    if by_month:
        inside = inside & F.col("call_month").between(F.date_format(start, "yyyy-MM"), F.date_format(end, "yyyy-MM"))
    return df.filter(inside)


def filter_options(
    calls: DataFrame, dimensions: Sequence[str] = tuple(CALL_DIMENSIONS.values())
) -> DataFrame:
    """Sorted distinct values of every dimension as (dimension, value) rows.

    The data is reduced to distinct combinations first; only those few rows
    are unfolded into one row per dimension.
    """
    present = [c for c in dimensions if c in calls.columns]
    pairs = ", ".join(f"struct('{c}' AS dimension, {c} AS value)" for c in present)
    return (
        calls.select(*present).distinct()
        .selectExpr(f"inline(array({pairs}))")
        .filter("value is not null")
        .distinct()
        .orderBy("dimension", "value")
    )
