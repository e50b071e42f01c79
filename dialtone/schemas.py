"""Declared schemas and the one place where inputs are made to fit them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()
_NTZ, _DATE, _DBL = T.TimestampNTZType(), T.DateType(), T.DoubleType()
_SECONDS, _MONEY, _RATE = T.DecimalType(18, 2), T.DecimalType(18, 4), T.DecimalType(18, 8)
_EXPECTED_VALUE = T.DecimalType(28, 8)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


AGENT_CALLS = _struct(
    call_id=_LONG, call_datetime_est=_NTZ, agent_name=_STR, employeeid=_LONG,
    call_direction=_STR, center_location=_STR, ib_contact_calls=_INT,
    credit_calls_ind=_INT, passed_credit_call_ind=_INT, credit_sold_calls_ind=_INT,
    conversion_exclude_ind=_INT, talk_time_seconds=_SECONDS, total_points=_DBL,
    marketing_code_id=_INT, pc=_STR, hire_date=_DATE,
)
SESSIONS = _struct(call_id=_LONG, session_start_date=_DATE)
ORDERS = _struct(
    call_id=_LONG, order_id=_LONG, undiscounted_gcv=_MONEY,
    predicted_activation_rate=_RATE, product_name=_STR,
    order_date_est=_NTZ, order_date_utc=_NTZ,
)
AGENTS = _struct(employeeid=_LONG, employee_name=_STR)
MARKETING = _struct(mcid=_INT, marketing_bucket=_STR)
CALLS = _struct(call_id=_LONG, permalease_call_ind=_INT, remote_number_call=_STR)
INTENTS = _struct(call_id=_LONG, movingSwitchingExtracted=_STR)

# The 28 columns of the call mart, in output order.
CALL_MART = _struct(
    call_id=_LONG, call_time_est=_NTZ, call_date_est=_DATE, week_start=_DATE,
    month_start=_DATE, pc=_STR, day_of_week=_STR, tenure_bucket=_STR,
    marketing_bucket=_STR, call_type=_STR, call_direction=_STR, membership=_STR,
    agent_name=_STR, center_location=_STR, moverSwitcher=_STR,
    ib_contact_calls=_INT, credit_calls_flag=_INT, passed_credit_call_flag=_INT,
    failed_credit_call_flag=_INT, passed_credit_sale_flag=_INT,
    failed_credit_sale_flag=_INT, orders=_LONG, gcv_fo=_EXPECTED_VALUE,
    total_revenue=_EXPECTED_VALUE, talk_time_minutes=_DBL,
    talk_time_minutes_sold=_DBL, talk_time_minutes_unsold=_DBL, tpsales_flag=_INT,
)

# The lift columns that are coerced to numbers.
LIFT_NUMERIC = (
    "talk_time_minutes", "order_orders", "gcv_revenue", "ibcalls",
    "credit_calls_ind", "passed_credit_call_ind", "ib_contact_calls",
    "passed_credit_sale", "failed_credit_sale",
)

LIFT_FACTS = _struct(
    period=_STR, week=_STR, post_week=_STR, cohort=_STR, canonical_cohort=_STR,
    call_datetime_est=_NTZ, call_date_fo=_NTZ, call_direction=_STR,
    marketing_bucket=_STR, mover_switcher=_STR, call_type=_STR, tenure_bucket=_STR,
    talk_time_minutes=_DBL, order_orders=_DBL, gcv_revenue=_DBL, ibcalls=_DBL,
    credit_calls_ind=_DBL, passed_credit_call_ind=_DBL, ib_contact_calls=_DBL,
    passed_credit_sale=_DBL, failed_credit_sale=_DBL,
)

# The texts a CSV reader of the reports treats as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def missing_to_null(text: Column) -> Column:
    """A text column with every spelling of "missing" turned into NULL."""
    return F.when(~text.isin(*MISSING_TEXTS), text)


def to_number(text: Column) -> Column:
    """Lenient numeric parse: what is not a number, NaN included, becomes NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def to_timestamp_strict(text: Column) -> Column:
    """Timestamp parse that fails the job on a malformed value."""
    return text.cast("timestamp_ntz")


def to_count(text: Column, kind: T.DataType) -> Column:
    """Whole number; a writer that had gaps in the column leaves "1.0" for 1. Anything else fails the job."""
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast(kind))
    wrong = F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast(kind)
    return F.when(text.isNotNull(), F.coalesce(F.when(text.rlike("^ *[+-]?[0-9]+ *$"), text.try_cast(kind)), whole, wrong))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the text columns of ``df`` that ``schema`` knows; keep the others.

    A column that no input had stays absent, so that a report can tell a
    missing column from one that holds only NULLs.
    """
    by_name: Mapping[str, T.StructField] = {f.name: f for f in schema.fields}

    def cast(name: str) -> Column:
        text = missing_to_null(F.col(f"`{name}`"))
        known = by_name.get(name)
        if known is None or known.dataType == _STR:
            return text.alias(name)
        if isinstance(known.dataType, (T.IntegerType, T.LongType)):
            return to_count(text, known.dataType).alias(name)
        if isinstance(known.dataType, T.DateType):
            return to_timestamp_strict(text).cast("date").alias(name)
        return text.cast(known.dataType).alias(name)

    return df.select(*[cast(c) for c in df.columns])


def conform(df: DataFrame, schema: T.StructType, role: str = "table") -> DataFrame:
    """``df`` with exactly the columns of ``schema``; an absent one is an error."""
    absent = [f.name for f in schema.fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"{role} lacks: " + ", ".join(absent))
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
