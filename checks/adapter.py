"""The test tables seen as call-center data.

One call is one row of ``events``; attributes come from the other tables. The
SQL in ``oracles.py`` states the same mapping independently.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialtone.config import ExtractConfig
from dialtone.plans.extract import Sources

LAUNCH = date(2024, 1, 15)
POST_WEEKS = ("01/15/2024", "01/22/2024", "01/29/2024")

EXTRACT = ExtractConfig(
    from_date=date(1997, 1, 1),
    excluded_agents=("Agent 3", "Agent 14"),
    excluded_centers=("CENTER_5",),
    non_lease_numbers=("3", "7"),
)


# Declared, so that opening a table needs no look into its files.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}
K = "int(regexp_extract(props, '[0-9]+', 0))"
DIRECTION = "CASE event_type WHEN 'purchase' THEN 'MANUAL_OUTBOUND' WHEN 'signup' THEN 'OUTBOUND' ELSE 'INBOUND' END"
PASSED = "CASE WHEN k < 25 THEN 1 WHEN k < 40 THEN 0 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines per call. Line numbers are small, so a bit per number counts
    the distinct ones; values are summed in ten-thousandths, which is exact."""
    cents = "bigint(round(l_extendedprice * 100)) * (100 - bigint(round(l_discount * 100)))"
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey AS event_id")).agg(
        F.expr("bigint(bit_count(bit_or(shiftleft(1L, l_linenumber)))) AS line_orders"),
        F.expr(f"sum({cents}) AS line_value"),
        F.expr("max(l_returnflag = 'R') AS has_r"),
        F.expr("max(l_returnflag = 'A') AS has_a"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-mart rows."""
    place = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr("c_custkey AS user_id", "c_name", "r_name")
    )
    info = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS event_id", "o_orderpriority", "o_orderstatus", "o_custkey")
    events = table(spark, sf_dir, "events").selectExpr(
        "*", f"{K} AS k", "CAST(ts AS DATE) AS day",
        "datediff(CAST(ts AS DATE), date_sub(DATE '2024-01-01', int(user_id % 200))) AS tenure")
    return (
        events.join(place, "user_id", "left").join(info, "event_id", "left")
        .join(_lines(spark, sf_dir), "event_id", "left")
        .selectExpr(
            "event_id AS call_id", "user_id AS agent_id", "k", "ts AS call_time_est", "day AS call_date_est",
            "if(coalesce(has_a, false), 'treatment', 'control') AS membership",
            "c_name AS agent_name", "r_name AS center_location", "o_orderpriority AS marketing_bucket",
            "CASE o_orderstatus WHEN 'F' THEN 'mover' WHEN 'P' THEN 'switcher' ELSE 'Uncollected' END AS moverSwitcher",
            """CASE WHEN tenure <= 30 THEN '0-30 day Tenure' WHEN tenure <= 60 THEN '31-60 day Tenure'
                WHEN tenure <= 90 THEN '61-90 day Tenure' WHEN tenure <= 120 THEN '91-120 day Tenure'
                WHEN tenure <= 150 THEN '121-150 day Tenure' ELSE 'Vet' END AS tenure_bucket""",
            "if(o_custkey % 3 = 0, 'Permalease', 'Site Session') AS call_type",
            f"{DIRECTION} AS call_direction",
            "int(k < 80) AS ib_contact_calls", "int(k < 50) AS credit_calls_flag",
            "int(k < 25) AS passed_credit_call_flag",
            "int(k >= 25 AND k < 40) AS failed_credit_call_flag",
            "int(k < 25 AND coalesce(line_orders, 0) >= 4) AS passed_credit_sale_flag",
            "int(k >= 25 AND k < 40 AND coalesce(line_orders, 0) >= 4) AS failed_credit_sale_flag",
            "coalesce(line_orders, 0) AS orders",
            "CAST(coalesce(line_value, 0) * 0.0001BD AS DECIMAL(18,4)) AS gcv_fo",
            "CAST(coalesce(line_value, 0) * 0.0001BD AS DECIMAL(18,4)) AS total_revenue",
            "CASE WHEN k <> 7 THEN value / 60D END AS talk_time_minutes",
            "int(coalesce(has_r, false)) AS tpsales_flag",
        )
    )


def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift facts: calls from the launch on are post rows; each earlier call is a
    fixed-baseline row and a weekly-baseline row of every post week."""
    def role(period: str, post_week: str = "NULL") -> str:
        return f"struct('{period}' AS period, CAST({post_week} AS STRING) AS post_week)"

    before = ", ".join([role("pre"), *[role("pre_weekly", f"'{w}'") for w in POST_WEEKS]])
    return calls(spark, sf_dir).selectExpr(
        f"inline(if(call_date_est >= DATE '{LAUNCH}', array({role('post')}), array({before})))",
        "date_format(trunc(call_date_est, 'week'), 'MM/dd/yyyy') AS week",
        "CASE WHEN agent_id % 7 <> 3 THEN if(agent_id % 2 = 0, 'treatment', 'control') END AS cohort",
        "CASE WHEN agent_id % 11 <> 5 THEN if(agent_id % 4 < 2, 'treatment', 'control') END AS canonical_cohort",
        "call_time_est AS call_datetime_est", "CAST(call_date_est AS TIMESTAMP_NTZ) AS call_date_fo",
        "call_direction", "marketing_bucket", "moverSwitcher AS mover_switcher", "call_type", "tenure_bucket",
        "talk_time_minutes", "orders AS order_orders", "total_revenue AS gcv_revenue",
        "int(call_direction = 'INBOUND') AS ibcalls", "credit_calls_flag AS credit_calls_ind",
        f"{PASSED} AS passed_credit_call_ind", "ib_contact_calls",
        "passed_credit_sale_flag AS passed_credit_sale", "failed_credit_sale_flag AS failed_credit_sale",
    )


def _agent_calls(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    """Two versions of every call; the older one starts five seconds earlier."""
    events = table(spark, sf_dir, "events").selectExpr("*", f"{K} AS k", "explode(array(0, 1)) AS version")
    return events.selectExpr(
        "event_id AS call_id", f"{at} AS call_datetime_est",
        "CASE WHEN k % 10 <> 3 THEN concat('Agent ', user_id) END AS agent_name",
        "user_id AS employeeid", f"{DIRECTION} AS call_direction",
        "CASE WHEN k <> 55 THEN concat('CENTER_', user_id % 6) END AS center_location",
        "CASE WHEN k < 80 THEN 1 END AS ib_contact_calls", "CASE WHEN k < 50 THEN 1 END AS credit_calls_ind",
        f"{PASSED} AS passed_credit_call_ind", "CASE WHEN k % 2 = 1 THEN 1 END AS credit_sold_calls_ind",
        "CASE WHEN k = 99 THEN 1 END AS conversion_exclude_ind",
        "CASE WHEN k <> 7 THEN CAST(value - 3 * version AS DECIMAL(18,2)) END AS talk_time_seconds",
        "k / 2D AS total_points", "CASE WHEN k >= 30 THEN k - 30 END AS marketing_code_id",
        "event_type AS pc", "date_sub(DATE '2024-01-01', int(user_id % 200)) AS hire_date",
    )


def extract_sources(spark: SparkSession, sf_dir: str, fan_out: bool = False) -> Sources:
    """Inputs of the extract.

    ``fan_out`` makes the two call lookups non-unique and lets calls of a day
    start together, so that anchors tie.
    """
    lines = table(spark, sf_dir, "lineitem")
    info = table(spark, sf_dir, "orders")
    at = "ts - version * INTERVAL '5' SECOND"
    if fan_out:
        at = f"CAST(CAST({at} AS DATE) AS TIMESTAMP_NTZ)"
        attributes = lines.selectExpr(
            "l_orderkey AS call_id", "int(l_linestatus = 'O') AS permalease_call_ind",
            "string(l_linenumber) AS remote_number_call")
        intents = lines.selectExpr(
            "l_orderkey AS call_id",
            "CASE l_returnflag WHEN 'R' THEN 'Moving' WHEN 'A' THEN 'switching' END AS movingSwitchingExtracted")
    else:
        attributes = info.selectExpr(
            "o_orderkey AS call_id", "int(o_orderstatus = 'P') AS permalease_call_ind",
            "CASE WHEN o_orderpriority <> '5-LOW' THEN string(o_custkey % 10) END AS remote_number_call")
        intents = info.selectExpr(
            "o_orderkey AS call_id",
            "CASE o_orderstatus WHEN 'F' THEN 'Moving' WHEN 'P' THEN 'switching' END AS movingSwitchingExtracted")
    return Sources(
        agent_calls=_agent_calls(spark, sf_dir, at),
        sessions=lines.filter("l_returnflag = 'A'").selectExpr(
            "l_orderkey AS call_id", "CAST(l_shipdate AS DATE) AS session_start_date"),
        orders=lines.selectExpr(
            "l_orderkey AS call_id", "bigint(l_linenumber) AS order_id",
            "CAST(bigint(round(l_extendedprice * 100)) * 0.01BD AS DECIMAL(18,2)) AS undiscounted_gcv",
            "CAST((100 - int(round(l_discount * 100))) * 0.01BD AS DECIMAL(4,2)) AS predicted_activation_rate",
            "if(l_returnflag = 'R', '12 Month - Prepaid', 'Other plan') AS product_name",
            "CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS order_date_est",
            "l_shipdate + INTERVAL '3' HOUR AS order_date_utc"),
        agents=table(spark, sf_dir, "customer").selectExpr(
            "c_custkey AS employeeid", "CASE WHEN c_acctbal > 0 THEN c_name END AS employee_name"),
        marketing=table(spark, sf_dir, "nation").selectExpr("n_nationkey AS mcid", "n_name AS marketing_bucket"),
        calls=attributes,
        intents=intents,
    )
