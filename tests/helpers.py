"""Small hand-made frames and plan inspection."""

from __future__ import annotations

from datetime import date, datetime

from dialtone.schemas import AGENT_CALLS, AGENTS, CALLS, INTENTS, MARKETING, ORDERS, SESSIONS
from dialtone.plans.extract import Sources

CALL_COLUMNS = (
    "call_date_est DATE, membership STRING, agent_name STRING, center_location STRING, marketing_bucket STRING, "
    "moverSwitcher STRING, tenure_bucket STRING, call_type STRING, call_direction STRING, ib_contact_calls INT, "
    "credit_calls_flag INT, passed_credit_call_flag INT, failed_credit_call_flag INT, passed_credit_sale_flag INT, "
    "failed_credit_sale_flag INT, orders BIGINT, gcv_fo DECIMAL(18,4), total_revenue DECIMAL(18,4), "
    "talk_time_minutes DOUBLE, tpsales_flag INT"
)
CALL_DEFAULTS = dict(
    call_date_est=date(2024, 1, 1), membership="treatment", agent_name="Ann", center_location="North",
    marketing_bucket="Web", moverSwitcher="mover", tenure_bucket="Vet", call_type="Site Session",
    call_direction="INBOUND", ib_contact_calls=0, credit_calls_flag=0, passed_credit_call_flag=0,
    failed_credit_call_flag=0, passed_credit_sale_flag=0, failed_credit_sale_flag=0, orders=0,
    gcv_fo=None, total_revenue=None, talk_time_minutes=None, tpsales_flag=0,
)
LIFT_COLUMNS = (
    "period STRING, week STRING, post_week STRING, cohort STRING, canonical_cohort STRING, "
    "call_datetime_est TIMESTAMP_NTZ, call_direction STRING, marketing_bucket STRING, mover_switcher STRING, "
    "call_type STRING, tenure_bucket STRING, talk_time_minutes DOUBLE, order_orders DOUBLE, gcv_revenue DOUBLE, "
    "credit_calls_ind DOUBLE, passed_credit_call_ind DOUBLE, ib_contact_calls DOUBLE"
)
LIFT_DEFAULTS = dict(
    period="post", week="01/15/2024", post_week=None, cohort="treatment", canonical_cohort=None,
    call_datetime_est=datetime(2024, 1, 16, 9), call_direction="INBOUND", marketing_bucket="Web",
    mover_switcher="mover", call_type="Site Session", tenure_bucket="Vet", talk_time_minutes=None,
    order_orders=None, gcv_revenue=None, credit_calls_ind=None, passed_credit_call_ind=None, ib_contact_calls=None,
)


def frame(spark, columns: str, defaults: dict, *rows: dict):
    names = list(defaults)
    return spark.createDataFrame([tuple({**defaults, **r}[n] for n in names) for r in rows], columns)


def _money(row: dict) -> dict:
    from decimal import Decimal
    return {k: Decimal(str(v)) if k in ("gcv_fo", "total_revenue") and v is not None else v for k, v in row.items()}


def calls(spark, *rows: dict):
    return frame(spark, CALL_COLUMNS, CALL_DEFAULTS, *[_money(r) for r in rows])


def lift_facts(spark, *rows: dict):
    return frame(spark, LIFT_COLUMNS, LIFT_DEFAULTS, *rows)


def rows_of(spark, schema, *rows: dict):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def sources(spark, **tables) -> Sources:
    schemas = dict(agent_calls=AGENT_CALLS, sessions=SESSIONS, orders=ORDERS, agents=AGENTS,
                   marketing=MARKETING, calls=CALLS, intents=INTENTS)
    return Sources(**{n: rows_of(spark, s, *tables.get(n, ())) for n, s in schemas.items()})


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by(df, *keys: str) -> dict:
    """Rows as dicts, by their key columns."""
    out = {}
    for r in df.collect():
        d = r.asDict()
        out[tuple(d[k] for k in keys) if len(keys) > 1 else d[keys[0]]] = d
    return out
