"""The registered queries in SQL, written apart from the Spark code.

Shared are only the texts that describe the test tables as call-center data.
"""

from __future__ import annotations

_SQL: dict[str, str] = {}

# --- the test tables as call-center data ---------------------------------------

KEYED = """
keyed AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         CASE event_type WHEN 'purchase' THEN 'MANUAL_OUTBOUND' WHEN 'signup' THEN 'OUTBOUND'
                         ELSE 'INBOUND' END AS direction
  FROM events)
"""

CALLS = KEYED + """,
line_sums AS (
  SELECT l_orderkey, count(DISTINCT l_linenumber) AS n,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS v,
         bool_or(l_returnflag = 'R') AS any_r, bool_or(l_returnflag = 'A') AS any_a
  FROM lineitem GROUP BY l_orderkey),
calls AS (
  SELECT e.event_id AS call_id, e.user_id AS agent_id, e.k, e.ts AS call_time_est,
         CAST(e.ts AS DATE) AS call_date_est,
         CASE WHEN any_a THEN 'treatment' ELSE 'control' END AS membership,
         c_name AS agent_name, r_name AS center_location, o_orderpriority AS marketing_bucket,
         CASE o_orderstatus WHEN 'F' THEN 'mover' WHEN 'P' THEN 'switcher' ELSE 'Uncollected' END AS moverSwitcher,
         CASE WHEN days <= 30 THEN '0-30 day Tenure' WHEN days <= 60 THEN '31-60 day Tenure'
              WHEN days <= 90 THEN '61-90 day Tenure' WHEN days <= 120 THEN '91-120 day Tenure'
              WHEN days <= 150 THEN '121-150 day Tenure' ELSE 'Vet' END AS tenure_bucket,
         CASE WHEN o_custkey % 3 = 0 THEN 'Permalease' ELSE 'Site Session' END AS call_type,
         e.direction AS call_direction,
         e.direction = 'INBOUND' AS ib,
         e.direction <> 'OUTBOUND' AS sell,
         CAST(e.k < 80 AS INTEGER) AS contact, CAST(e.k < 50 AS INTEGER) AS credit,
         CAST(e.k < 25 AS INTEGER) AS passed, CAST(e.k >= 25 AND e.k < 40 AS INTEGER) AS failed,
         CAST(e.k < 25 AND coalesce(n, 0) >= 4 AS INTEGER) AS passed_sale,
         CAST(e.k >= 25 AND e.k < 40 AND coalesce(n, 0) >= 4 AS INTEGER) AS failed_sale,
         coalesce(n, 0) AS orders, coalesce(v, 0) AS revenue,
         CASE WHEN e.k <> 7 THEN e.value / 60.0::DOUBLE END AS minutes,
         CAST(coalesce(any_r, false) AS INTEGER) AS top_product
  FROM (SELECT *, date_diff('day', DATE '2024-01-01' - CAST(user_id % 200 AS INTEGER), CAST(ts AS DATE)) AS days
        FROM keyed) e
  LEFT JOIN customer ON c_custkey = e.user_id
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN orders ON o_orderkey = e.event_id
  LEFT JOIN line_sums ON l_orderkey = e.event_id),
treated AS (SELECT * FROM calls WHERE membership = 'treatment')
"""

LIFT = CALLS + """,
lift_roles AS (
  SELECT *, 'post' AS period, CAST(NULL AS VARCHAR) AS post_week FROM calls WHERE call_date_est >= DATE '2024-01-15'
  UNION ALL
  SELECT *, 'pre', NULL FROM calls WHERE call_date_est < DATE '2024-01-15'
  UNION ALL
  SELECT calls.*, 'pre_weekly', w FROM calls, (VALUES ('01/15/2024'), ('01/22/2024'), ('01/29/2024')) t(w)
  WHERE call_date_est < DATE '2024-01-15'),
lift AS (
  SELECT period, post_week, strftime(date_trunc('week', call_date_est), '%m/%d/%Y') AS week,
         CASE WHEN agent_id % 7 <> 3 THEN CASE agent_id % 2 WHEN 0 THEN 'treatment' ELSE 'control' END END AS cohort,
         CASE WHEN agent_id % 11 <> 5 THEN CASE WHEN agent_id % 4 < 2 THEN 'treatment' ELSE 'control' END END AS fixed_cohort,
         call_time_est, call_date_est, marketing_bucket, moverSwitcher AS mover_switcher, call_type, tenure_bucket,
         ib, sell, minutes, orders, revenue, contact, credit,
         CASE WHEN k < 25 THEN 1 WHEN k < 40 THEN 0 END AS passed_ind
  FROM lift_roles)
"""

VERSIONS = KEYED + """,
versions AS (
  SELECT event_id AS call_id, {at} AS started, user_id AS agent, k, direction, event_type,
         CASE WHEN k % 10 <> 3 THEN 'Agent ' || user_id END AS agent_name,
         CASE WHEN k <> 55 THEN 'CENTER_' || (user_id % 6) END AS center,
         CASE WHEN k < 25 THEN 1 WHEN k < 40 THEN 0 END AS passed_ind,
         CASE WHEN k <> 7 THEN CAST(value - 3 * version AS DECIMAL(18,2)) END AS talk
  FROM keyed, (VALUES (0), (1)) t(version)),
scoped AS (SELECT * FROM versions WHERE started >= TIMESTAMP '1997-01-01' AND k <> 99),
newest AS (
  SELECT * FROM scoped
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY started DESC NULLS LAST, talk DESC NULLS LAST) = 1)
"""
_EXACT = "(ts - version * INTERVAL 5 SECOND)"
_BY_DAY = "CAST(CAST(ts - version * INTERVAL 5 SECOND AS DATE) AS TIMESTAMP)"

ANCHORS = """,
anchor_times AS (
  SELECT s.call_id AS short_call_id, max(l.started) AS anchor_at
  FROM newest s JOIN newest l ON l.agent = s.agent AND l.talk > 30 AND l.started <= s.started
  WHERE s.talk <= 30 GROUP BY s.call_id),
anchor_ids AS (
  SELECT t.short_call_id, l.call_id AS anchor_call_id
  FROM anchor_times t
  JOIN newest l ON l.started = t.anchor_at AND l.talk > 30
  JOIN newest s ON s.call_id = t.short_call_id AND s.agent = l.agent)
"""

REGISTERED = """,
registered AS (
  SELECT DISTINCT l_orderkey AS call_id FROM lineitem
  WHERE l_returnflag = 'A' AND CAST(l_shipdate AS DATE) >= DATE '1997-01-01')
"""

ORDER_SUMS = """,
order_sums AS (
  SELECT l_orderkey AS call_id, count(DISTINCT l_linenumber) AS order_count,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))) AS order_value,
         CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS has_prepaid
  FROM lineitem
  WHERE l_orderkey IN (SELECT call_id FROM scoped)
    AND CAST(CASE WHEN l_linestatus = 'F' THEN l_shipdate
             ELSE timezone('America/New_York', timezone('UTC', l_shipdate + INTERVAL 3 HOUR)) END AS DATE)
        >= DATE '1997-01-01'
  GROUP BY l_orderkey)
"""

# --- small helpers --------------------------------------------------------------


def _div(num: str, den: str, guard: str = "> 0") -> str:
    return f"CASE WHEN {den} {guard} THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def _r(expr: str, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-9::DOUBLE, {places})"


def _values(metrics: dict[str, str]) -> str:
    """The metrics of one summed row as (position, metric, value) rows."""
    rows = ", ".join(f"({i}, '{n}', CAST({e} AS DOUBLE))" for i, (n, e) in enumerate(metrics.items(), 1))
    return f'(VALUES {rows}) v("position", metric, "value")'


SUMS = """
  count(*) FILTER (ib) AS n, sum(contact) FILTER (ib) AS contact, sum(credit) FILTER (ib) AS credit,
  sum(passed) FILTER (ib) AS passed, sum(failed) FILTER (ib) AS failed,
  sum(passed_sale) FILTER (ib) AS psale, sum(failed_sale) FILTER (ib) AS fsale,
  coalesce(sum(orders) FILTER (sell), 0) AS orders, sum(top_product) FILTER (sell) AS tp,
  coalesce(sum(revenue) FILTER (sell), 0) AS revenue,
  sum(orders) FILTER (ib) AS ib_orders, sum(top_product) FILTER (ib) AS ib_tp,
""" + ", ".join(
    # exact sums, so that shown digits do not depend on the order of the rows
    f"CAST(sum(CAST(minutes AS DECIMAL(28,10))) FILTER ({rows}) AS DOUBLE) / nullif(count(minutes) FILTER ({rows}), 0) AS {name}"
    for name, rows in {"talk": "ib", "sold": "ib AND orders > 0", "unsold": "ib AND orders = 0"}.items()
) + "\n"

FUNNEL = {
    "Calls": "n", "CiContact": _div("contact", "n"), "CiCredit": _div("credit", "n"),
    "PCR": _div("passed", "credit"), "PCC": _div("psale", "passed"), "FCC": _div("fsale", "failed"),
    "NC": _div("orders", "n"), "TPM": _div("tp", "orders"), "Revenue": "revenue",
    "RPNC": _div("revenue", "n"), "RPO": _div("revenue", "orders"),
    "Talk Time": "talk", "Sold Talk Time": "sold", "Unsold Talk Time": "unsold",
}
TREND = {
    "Net Conversion": _div("ib_orders", "n"), "Total Revenue": "revenue", "Rev / Call": _div("revenue", "n"),
    "Rev / Order": _div("revenue", "orders"), "Top Product Mix": _div("ib_tp", "ib_orders"),
    "Contact Rate": _div("contact", "n"), "Credit Rate": _div("credit", "n"),
    "Passed Credit Rate": _div("passed", "credit"), "Passed Credit Conv.": _div("psale", "passed"),
    "Failed Credit Conv.": _div("fsale", "failed"), "Talk Time": "talk", "Calls": "n",
}
CARDS = {
    "Rev / Call": _div("revenue", "n"), "Net Conversion": _div("orders", "n"),
    "Rev / Order": _div("revenue", "orders"), "Calls Into Credit": _div("credit", "n"), "Talk Time": "talk",
}
UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}
DIMENSIONS = {
    "center": "center_location", "marketing": "marketing_bucket", "mover": "moverSwitcher",
    "tenure": "tenure_bucket", "call_type": "call_type",
}
LIFT_DIMENSIONS = {
    "marketing": "marketing_bucket", "mover": "mover_switcher", "tenure": "tenure_bucket", "call_type": "call_type",
}


def _bucket(unit: str, day: str = "call_date_est") -> str:
    return f"CAST(date_trunc('{unit}', {day}) AS DATE)"


# --- extract --------------------------------------------------------------------

_SQL["dedup_latest_version"] = """
SELECT * FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey
  ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST,
           l_linenumber DESC NULLS LAST, l_quantity DESC NULLS LAST, l_extendedprice DESC NULLS LAST,
           l_discount DESC NULLS LAST, l_tax DESC NULLS LAST, l_returnflag DESC NULLS LAST,
           l_linestatus DESC NULLS LAST) = 1
"""
_SQL["scope_lower_bound"] = f"""
WITH {VERSIONS.format(at=_EXACT)}
SELECT call_id, started AS call_datetime_est, agent AS employeeid, CAST(talk AS DOUBLE) AS talk_seconds
FROM versions WHERE started >= TIMESTAMP '2024-01-12' AND k <> 99
"""
_SQL["anchor_times"] = f"WITH {VERSIONS.format(at=_EXACT)} {ANCHORS} SELECT * FROM anchor_times"
_SQL["anchor_calls"] = f"WITH {VERSIONS.format(at=_EXACT)} {ANCHORS} SELECT * FROM anchor_ids"
_SQL["anchor_calls_tied"] = f"WITH {VERSIONS.format(at=_BY_DAY)} {ANCHORS} SELECT * FROM anchor_ids"
_SQL["anchor_calls_one"] = f"""
WITH {VERSIONS.format(at=_BY_DAY)} {ANCHORS}
SELECT short_call_id, min(anchor_call_id) AS anchor_call_id FROM anchor_ids GROUP BY 1
"""
_SQL["anchor_classes"] = f"""
WITH {VERSIONS.format(at=_BY_DAY)} {ANCHORS},
short AS (SELECT short_call_id, min(anchor_call_id) AS class FROM anchor_ids GROUP BY 1),
member AS (
  SELECT class, anchor_at, short_call_id AS call_id, false AS is_anchor FROM short JOIN anchor_times USING (short_call_id)
  UNION SELECT class, anchor_at, anchor_call_id, true FROM short JOIN anchor_ids USING (short_call_id) JOIN anchor_times USING (short_call_id))
SELECT class, agent AS employeeid, anchor_at, call_id, is_anchor FROM member JOIN newest USING (call_id)
"""
_SQL["anchor_classes_unfolded"] = _SQL["anchor_calls_tied"]
_SQL["registry_membership"] = """
SELECT event_id AS call_id, CAST(EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'A'
  AND l_shipdate >= TIMESTAMP '1997-01-01') AS INTEGER) AS registered
FROM events
"""
_SQL["order_rollup"] = f"""
WITH {VERSIONS.format(at=_EXACT)} {ORDER_SUMS}
SELECT call_id, order_count, {_r('order_value', 4)} AS order_value, has_prepaid FROM order_sums
"""
_SQL["lookup_uniqueness"] = """
WITH copies AS (
  SELECT 'agents' AS t, c_custkey AS k, count(*) AS c FROM customer GROUP BY ALL
  UNION ALL SELECT 'marketing', n_nationkey, count(*) FROM nation GROUP BY ALL
  UNION ALL SELECT 'calls', l_orderkey, count(*) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'intents', l_orderkey, count(*) FROM lineitem GROUP BY ALL)
SELECT t AS table_name, count(*) AS key_count, count(*) FILTER (c > 1) AS repeated_keys,
       CAST(sum(c - 1) AS BIGINT) AS extra_rows, max(c) AS max_copies
FROM copies GROUP BY t
"""

_ORDER_ATTRIBUTES = """,
attributes AS (
  SELECT o_orderkey AS call_id, CAST(o_orderstatus = 'P' AS INTEGER) AS lease,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey % 10 AS VARCHAR) END AS number FROM orders),
intents AS (
  SELECT o_orderkey AS call_id, CASE o_orderstatus WHEN 'F' THEN 'Moving' WHEN 'P' THEN 'switching' END AS intent
  FROM orders)
"""
_LINE_ATTRIBUTES = """,
attributes AS (
  SELECT l_orderkey AS call_id, CAST(l_linestatus = 'O' AS INTEGER) AS lease,
         CAST(l_linenumber AS VARCHAR) AS number FROM lineitem),
intents AS (
  SELECT l_orderkey AS call_id, CASE l_returnflag WHEN 'R' THEN 'Moving' WHEN 'A' THEN 'switching' END AS intent
  FROM lineitem)
"""
_MART = """,
mart AS (
  SELECT
    n.call_id, n.started AS call_time_est, CAST(n.started AS DATE) AS call_date_est,
    CAST(date_trunc('week', n.started) AS DATE) AS week_start, CAST(date_trunc('month', n.started) AS DATE) AS month_start,
    n.event_type AS pc, dayname(n.started) AS day_of_week,
    CASE WHEN d <= 30 THEN '0-30 day Tenure' WHEN d <= 60 THEN '31-60 day Tenure' WHEN d <= 90 THEN '61-90 day Tenure'
         WHEN d <= 120 THEN '91-120 day Tenure' WHEN d <= 150 THEN '121-150 day Tenure' ELSE 'Vet' END AS tenure_bucket,
    coalesce(n_name, 'Other') AS marketing_bucket,
    CASE WHEN lease = 1 AND number NOT IN ('3', '7') THEN 'Permalease' ELSE 'Site Session' END AS call_type,
    direction AS call_direction,
    CASE WHEN talk <= 30 THEN CASE WHEN ra.call_id IS NOT NULL THEN 'treatment' ELSE 'control' END
         ELSE CASE WHEN r.call_id IS NOT NULL THEN 'treatment' ELSE 'control' END END AS membership,
    coalesce(n.agent_name, CASE WHEN c_acctbal > 0 THEN c_name END) AS agent_name,
    coalesce(n.center, 'UNKNOWN') AS center_location,
    CASE upper(intent) WHEN 'MOVING' THEN 'mover' WHEN 'SWITCHING' THEN 'switcher' ELSE 'Uncollected' END AS moverSwitcher,
    CAST(k < 80 AS INTEGER) AS ib_contact_calls,
    CAST(k < 50 AS INTEGER) AS credit_calls_flag,
    CAST(k < 25 AS INTEGER) AS passed_credit_call_flag,
    CAST(k >= 25 AND k < 40 AS INTEGER) AS failed_credit_call_flag,
    CAST(k % 2 = 1 AND k < 25 AS INTEGER) AS passed_credit_sale_flag,
    CAST(k % 2 = 1 AND k >= 25 AND k < 40 AND coalesce(order_count, 0) > 0 AS INTEGER) AS failed_credit_sale_flag,
    coalesce(order_count, 0) AS orders, coalesce(order_value, 0) AS gcv_fo, coalesce(order_value, 0) AS total_revenue,
    CAST(talk AS DOUBLE) / 60 AS talk_time_minutes,
    CASE WHEN coalesce(order_count, 0) > 0 THEN CAST(talk AS DOUBLE) / 60 END AS talk_time_minutes_sold,
    CASE WHEN coalesce(order_count, 0) = 0 THEN CAST(talk AS DOUBLE) / 60 END AS talk_time_minutes_unsold,
    CAST(k / 2.0 >= 25 OR coalesce(has_prepaid, 0) = 1 AS INTEGER) AS tpsales_flag
  FROM (SELECT *, date_diff('day', DATE '2024-01-01' - CAST(agent % 200 AS INTEGER), CAST(started AS DATE)) AS d FROM newest) n
  LEFT JOIN registered r ON r.call_id = n.call_id
  LEFT JOIN anchor_ids a ON a.short_call_id = n.call_id
  LEFT JOIN registered ra ON ra.call_id = a.anchor_call_id
  LEFT JOIN order_sums o ON o.call_id = n.call_id
  LEFT JOIN customer ON c_custkey = n.agent
  LEFT JOIN nation ON n_nationkey = CASE WHEN k >= 30 THEN k - 30 ELSE 0 END
  LEFT JOIN attributes t ON t.call_id = n.call_id
  LEFT JOIN intents i ON i.call_id = n.call_id
  WHERE coalesce(n.agent_name, CASE WHEN c_acctbal > 0 THEN c_name END) NOT IN ('Agent 3', 'Agent 14')
    AND coalesce(n.center, '') <> 'CENTER_5')
"""
_PLAIN_MART = VERSIONS.format(at=_EXACT) + ANCHORS + REGISTERED + ORDER_SUMS + _ORDER_ATTRIBUTES + _MART
_FAN_OUT_MART = VERSIONS.format(at=_BY_DAY) + ANCHORS + REGISTERED + ORDER_SUMS + _LINE_ATTRIBUTES + _MART

_SQL["call_mart"] = f"""
WITH {_PLAIN_MART}
SELECT * REPLACE (
  {_r('gcv_fo', 4)} AS gcv_fo, {_r('total_revenue', 4)} AS total_revenue,
  {_r('talk_time_minutes')} AS talk_time_minutes, {_r('talk_time_minutes_sold')} AS talk_time_minutes_sold,
  {_r('talk_time_minutes_unsold')} AS talk_time_minutes_unsold)
FROM mart
"""
_SQL["call_mart_newest_first"] = f"""
WITH {_PLAIN_MART}
SELECT * REPLACE (
  {_r('gcv_fo', 4)} AS gcv_fo, {_r('total_revenue', 4)} AS total_revenue,
  {_r('talk_time_minutes')} AS talk_time_minutes, {_r('talk_time_minutes_sold')} AS talk_time_minutes_sold,
  {_r('talk_time_minutes_unsold')} AS talk_time_minutes_unsold)
FROM mart ORDER BY call_time_est DESC, call_id
"""
_SQL["mart_from_tables"] = _SQL["call_mart"]
_SQL["mart_over_a_seam"] = _SQL["call_mart"]
_SQL["call_mart_one"] = f"""
WITH {VERSIONS.format(at=_BY_DAY) + ANCHORS.replace("anchor_ids AS (", "all_anchor_ids AS (")},
anchor_ids AS (SELECT short_call_id, min(anchor_call_id) AS anchor_call_id FROM all_anchor_ids GROUP BY 1)
{REGISTERED + ORDER_SUMS + _LINE_ATTRIBUTES + _MART}
SELECT call_id, membership, call_type, moverSwitcher, count(*) AS copies, CAST(sum(orders) AS BIGINT) AS orders_sum
FROM mart GROUP BY ALL
"""
_SQL["call_mart_fan_out"] = f"""
WITH {_FAN_OUT_MART}
SELECT call_id, membership, call_type, moverSwitcher, count(*) AS copies, CAST(sum(orders) AS BIGINT) AS orders_sum
FROM mart GROUP BY ALL
"""
_SQL["call_mart_months"] = f"""
WITH {_PLAIN_MART}
SELECT strftime(call_date_est, '%Y-%m') AS call_month, count(*) AS saved_rows FROM mart GROUP BY 1 ORDER BY 1
"""

_MONTH_TOTALS = """
SELECT strftime(o_orderdate, '%Y-%m') AS call_month,
       o_orderpriority || chr(10) || '"' || o_orderstatus || '", ok' AS marketing_bucket, count(*) AS saved_rows,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) + 1e-9::DOUBLE, 2) AS revenue,
       CAST(sum(CASE WHEN {contact} THEN 1 END) AS BIGINT) AS contacts
FROM orders GROUP BY 1, 2
"""
_SQL["month_files_parquet"] = _MONTH_TOTALS.format(contact="o_orderstatus <> 'P'")
_SQL["month_refresh_midmonth"] = _SQL["month_files_parquet"]
_SQL["month_refresh_moved_calls"] = _SQL["month_files_parquet"]
_SQL["default_window_of_mart"] = """
WITH last AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderkey % 5 < 2)
SELECT CAST(o_orderdate AS DATE) AS call_date_est, count(*) AS calls_seen FROM orders, last
WHERE o_orderkey % 5 < 2 AND o_orderstatus <> 'P' AND o_orderdate > d - 7 GROUP BY 1
"""
_SQL["month_files_csv"] = _MONTH_TOTALS.format(contact="o_orderstatus <> 'P'")
_SQL["call_files_by_name"] = _MONTH_TOTALS.format(contact="o_orderstatus <> 'P' AND o_orderdate < DATE '1998-01-01'")

# --- populations ----------------------------------------------------------------

_SQL["filter_options"] = f"WITH {CALLS} " + " UNION ".join(
    f'SELECT \'{c}\' AS dimension, {c} AS "value" FROM calls WHERE {c} IS NOT NULL' for c in DIMENSIONS.values())
_SELECTED = """membership = 'treatment' AND call_date_est BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
  AND center_location IN ('ASIA', 'EUROPE', 'AFRICA') AND marketing_bucket IN ('1-URGENT', '2-HIGH', '5-LOW')
  AND moverSwitcher IN ('mover', 'switcher') AND tenure_bucket IN ('Vet', '31-60 day Tenure', '61-90 day Tenure')
  AND call_type = 'Site Session'"""
_SQL["filtered_population"] = f"""
WITH {CALLS}
SELECT call_id, call_date_est, center_location, marketing_bucket, moverSwitcher, tenure_bucket, call_type
FROM calls WHERE {_SELECTED}
"""
_SQL["day_bounds"] = """
SELECT min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events
"""
# the test data covers more than two weeks, so no bound is clamped
_SQL["default_windows"] = """
WITH last AS (SELECT max(CAST(ts AS DATE)) AS d FROM events)
SELECT v.bound, v."day" FROM last, (VALUES
  ('window_start', d - 6), ('window_end', d), ('p1_start', d - 13), ('p1_end', d - 7),
  ('p2_start', d - 6), ('p2_end', d)) v(bound, "day")
"""
_SQL["default_window_calls"] = f"""
WITH {CALLS}
SELECT call_date_est, count(*) AS calls_seen FROM treated
WHERE call_date_est > (SELECT max(call_date_est) - 7 FROM treated) GROUP BY 1
"""
_SQL["row_scopes"] = """
SELECT CASE event_type WHEN 'purchase' THEN 'MANUAL_OUTBOUND' WHEN 'signup' THEN 'OUTBOUND' ELSE 'INBOUND' END AS call_direction,
       count(*) FILTER (event_type NOT IN ('purchase', 'signup')) AS top_funnel_calls,
       count(*) FILTER (event_type <> 'signup') AS order_revenue_calls
FROM events GROUP BY 1
"""
_SQL["period_buckets"] = """
SELECT CAST(o_orderdate AS DATE) AS day_start, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_begin,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_begin,
       strftime(date_trunc('week', o_orderdate), '%b %d') AS week_label,
       strftime(date_trunc('month', o_orderdate), '%b %Y') AS month_label,
       dayname(o_orderdate) AS weekday, count(*) AS order_rows
FROM orders GROUP BY ALL
"""

# --- overview -------------------------------------------------------------------

_SQL["kpi_totals"] = f"WITH {CALLS}, s AS (SELECT {SUMS} FROM treated) SELECT " + ", ".join(
    f"{_r(e)} AS {n}" for n, e in {
        "n_calls": "n", "contact_rate": _div("contact", "n"), "credit_rate": _div("credit", "n"),
        "pass_credit_rate": _div("passed", "credit"), "fail_credit_rate": _div("failed", "credit"),
        "pass_credit_conv": _div("psale", "passed"), "fail_credit_conv": _div("fsale", "failed"),
        "net_conversion": _div("orders", "n"), "top_product_mix": _div("tp", "orders"),
        "total_revenue": "revenue", "rev_per_call": _div("revenue", "n"), "rev_per_order": _div("revenue", "orders"),
        "talk_time": "talk", "talk_time_sold": "sold", "talk_time_unsold": "unsold",
    }.items()) + " FROM s"

for _name, _unit in UNITS.items():
    _label = "%b %Y" if _unit == "month" else "%b %d"
    _SQL["funnel_" + _name] = f"""
WITH {CALLS}, s AS (SELECT {_bucket(_unit)} AS period, {SUMS} FROM treated GROUP BY 1)
SELECT period, v."position", v.metric, {_r('v."value"')} AS "value", strftime(period, '{_label}') AS label
FROM s, {_values(FUNNEL)}
"""
_SQL["funnel_from_rollup"] = _SQL["funnel_weekly"]
_SQL["cached_funnel"] = _SQL["funnel_weekly"]
_SQL["report_export_tsv"] = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS period, {SUMS} FROM treated GROUP BY 1)
SELECT period, v.metric,
       CASE WHEN v.metric = 'Calls' THEN 'count' WHEN v.metric LIKE '%Talk Time' THEN 'decimal'
            WHEN v.metric IN ('Revenue', 'RPNC', 'RPO') THEN 'dollar' ELSE 'pct' END AS kind,
       {_r('v."value"')} AS "value"
FROM s, {_values(FUNNEL)}
"""
_SQL["funnel_filtered"] = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS period, {SUMS} FROM calls WHERE {_SELECTED} GROUP BY 1)
SELECT period, """ + ", ".join(f'{_r(e)} AS "{n}"' for n, e in FUNNEL.items()) + " FROM s"
_SQL["funnel_table_weekly"] = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS period, {SUMS} FROM treated GROUP BY 1),
cells AS (SELECT period, v."position", v.metric, {_r('v."value"')} AS cell FROM s, {_values(FUNNEL)})
SELECT "position", metric, """ + ", ".join(
    f"max(cell) FILTER (period = DATE '{w}') AS \"{w}\""
    for w in ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")) + """
FROM cells GROUP BY 1, 2
"""
_SQL["funnel_table_discovered"] = _SQL["funnel_table_weekly"]
_KIND = """CASE WHEN v.metric = 'Calls' THEN 'count' WHEN v.metric LIKE '%Talk Time' THEN 'decimal'
            WHEN v.metric IN ('Revenue', 'RPNC', 'RPO') THEN 'dollar' ELSE 'pct' END"""
_SQL["funnel_shown_weekly"] = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS period, {SUMS} FROM treated GROUP BY 1)
SELECT period, v.metric, {_KIND} AS kind, strftime(period, '%b %d') AS label, coalesce(
  CASE WHEN v."value" IS NULL THEN NULL
       WHEN v.metric = 'Calls' THEN format('{{:,}}', CAST(v."value" AS BIGINT))
       WHEN v.metric IN ('Revenue', 'RPNC', 'RPO') THEN format('${{:,.2f}}', v."value")
       WHEN v.metric LIKE '%Talk Time' THEN format('{{:.2f}}', v."value")
       ELSE format('{{:.1f}}%', v."value" * 100) END, '—') AS shown
FROM s, {_values(FUNNEL)}
"""
_SQL["funnel_from_written_rollup"] = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS period, {SUMS} FROM treated
  WHERE call_date_est BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY 1)
SELECT period, """ + ", ".join(f'{_r(e)} AS "{n}"' for n, e in FUNNEL.items()) + " FROM s"
_SQL["funnel_from_extract"] = f"""
WITH {_PLAIN_MART},
m AS (SELECT call_date_est, call_direction = 'INBOUND' AS ib, call_direction <> 'OUTBOUND' AS sell,
             ib_contact_calls AS contact, credit_calls_flag AS credit, passed_credit_call_flag AS passed,
             failed_credit_call_flag AS failed, passed_credit_sale_flag AS passed_sale,
             failed_credit_sale_flag AS failed_sale, orders, total_revenue AS revenue,
             talk_time_minutes AS minutes, tpsales_flag AS top_product
      FROM mart WHERE membership = 'treatment'),
s AS (SELECT {_bucket('month')} AS period, {SUMS} FROM m GROUP BY 1)
SELECT period, v."position", v.metric, {_r('v."value"')} AS "value" FROM s, {_values(FUNNEL)}
"""

_CARDS = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS week, {SUMS} FROM treated GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY week DESC) AS age FROM s),
cells AS (SELECT age, week, v.* FROM ranked, {_values(CARDS)} WHERE age <= 2),
cards AS (
  SELECT "position", metric, max(week) FILTER (age = 1) AS week, max(week) FILTER (age = 2) AS prior_week,
         max("value") FILTER (age = 1) AS v1, max("value") FILTER (age = 2) AS v2
  FROM cells GROUP BY 1, 2)
"""
_SQL["week_cards"] = _CARDS + f"""
SELECT "position", metric, week, prior_week, {_r('v1')} AS "value", {_r('v2')} AS prior_value,
       {_r("CASE WHEN v2 <> 0 THEN (v1 / v2 - 1) * 100.0::DOUBLE END")} AS change_pct FROM cards
"""
_SQL["week_cards_selected"] = _SQL["week_cards"].replace(
    "FROM treated GROUP BY", "FROM calls WHERE " + _SELECTED.replace(" AND call_date_est BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", "") + " GROUP BY")
_SQL["week_cards_shown"] = _CARDS + """
SELECT "position", metric,
       CASE WHEN v1 IS NULL OR v1 = 0 THEN '—'
            WHEN metric LIKE 'Rev%' THEN format('${:,.2f}', v1)
            WHEN metric = 'Talk Time' THEN format('{:.1f} min', v1)
            ELSE format('{:.1f}%', v1 * 100) END AS shown,
       CASE WHEN v2 <> 0 THEN format('{:+.1f}% vs prior wk', (v1 / v2 - 1) * 100) END AS delta
FROM cards
"""


def _comparison(first: str, second: str) -> str:
    return f"""
WITH {CALLS}, bounds AS (SELECT max(call_date_est) AS last_day FROM treated),
a AS (SELECT {SUMS} FROM treated, bounds WHERE call_date_est BETWEEN {first}),
b AS (SELECT {SUMS} FROM treated, bounds WHERE call_date_est BETWEEN {second}),
x AS (SELECT v.* FROM a, {_values(FUNNEL)}), y AS (SELECT v.* FROM b, {_values(FUNNEL)}),
both_periods AS (
  SELECT x."position", x.metric, x."value" AS v1, y."value" AS v2,
         CASE WHEN x."value" <> 0 THEN (y."value" / x."value" - 1) * 100.0::DOUBLE END AS pct
  FROM x JOIN y USING (metric)),
classed AS (
  SELECT *, CAST(format('{{:.1f}}', pct) AS DOUBLE) AS shown_pct FROM both_periods)
"""


_CLASS = """CASE WHEN pct IS NULL THEN NULL WHEN abs(shown_pct) < 1.5 THEN 'neutral'
            WHEN (shown_pct > 0) = (metric NOT LIKE '%Talk Time') THEN 'better' ELSE 'worse' END"""
_SQL["period_comparison"] = _comparison(
    "DATE '2024-01-04' AND DATE '2024-01-15'", "DATE '2024-01-12' AND DATE '2024-01-24'") + f"""
SELECT "position", metric, {_r('v1')} AS first_value, {_r('v2')} AS second_value, {_r('pct')} AS change_pct,
       {_CLASS} AS change_class
FROM classed
"""


def _text(v: str) -> str:
    return f"""coalesce(CASE WHEN {v} IS NULL THEN NULL
       WHEN metric = 'Calls' THEN format('{{:,}}', CAST({v} AS BIGINT))
       WHEN metric IN ('Revenue', 'RPNC', 'RPO') THEN format('${{:,.2f}}', {v})
       WHEN metric LIKE '%Talk Time' THEN format('{{:.2f}}', {v})
       ELSE format('{{:.1f}}%', {v} * 100) END, '—')"""


_SQL["period_comparison_incomplete"] = _comparison(
    "DATE '2024-01-02' AND DATE '2024-01-01'", "DATE '2024-01-12' AND DATE '2024-01-24'") + f"""
SELECT "position", metric, {_r('v1')} AS first_value, {_r('v2')} AS second_value, {_r('pct')} AS change_pct,
       {_CLASS} AS change_class
FROM classed
"""
_SQL["period_comparison_default"] = _comparison(
    "last_day - 13 AND last_day - 7", "last_day - 6 AND last_day") + f"""
SELECT "position", metric, {_text('v1')} AS first_shown, {_text('v2')} AS second_shown,
       coalesce(format('{{:+.1f}}%', pct), '—') AS change_shown, {_CLASS} AS change_class
FROM classed
"""

for _name, _unit in UNITS.items():
    _SQL["trend_" + _name] = f"""
WITH {CALLS}, s AS (SELECT {_bucket(_unit)} AS period, {SUMS} FROM treated GROUP BY 1)
SELECT 'Overall' AS series, period, v.metric, {_r('v."value"')} AS "value" FROM s, {_values(TREND)}
"""
for _name, _column in DIMENSIONS.items():
    _SQL[f"trend_by_{_name}"] = f"""
WITH {CALLS}, s AS (
  SELECT {_column} AS series, {_bucket('week')} AS period, {SUMS} FROM treated WHERE {_column} IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT 'Overall', {_bucket('week')}, {SUMS} FROM treated GROUP BY 2)
SELECT series, period, v.metric, {_r('v."value"')} AS "value" FROM s, {_values(TREND)}
"""
    _SQL[f"snapshot_by_{_name}"] = f"""
WITH {CALLS}, s AS (SELECT {_column} AS category, {SUMS} FROM treated WHERE {_column} IS NOT NULL GROUP BY 1)
SELECT category, v.metric, {_r('v."value"')} AS "value" FROM s, {_values(TREND)}
"""
_SQL["snapshot_overall"] = f"""
WITH {CALLS}, s AS (SELECT 'Overall' AS category, {SUMS} FROM treated)
SELECT category, v.metric, {_r('v."value"')} AS "value" FROM s, {_values(TREND)}
"""

_SQL["snapshot_shown"] = f"""
WITH {CALLS}, s AS (SELECT moverSwitcher AS category, {SUMS} FROM treated WHERE moverSwitcher IS NOT NULL GROUP BY 1)
SELECT category, v.metric, coalesce(
  CASE WHEN v."value" IS NULL THEN NULL
       WHEN v.metric = 'Calls' THEN format('{{:,}}', CAST(v."value" AS BIGINT))
       WHEN v.metric LIKE '%Rev%' THEN format('${{:,.0f}}', v."value")
       WHEN v.metric = 'Talk Time' THEN format('{{:.1f}}', v."value")
       ELSE format('{{:.1f}}%', v."value" * 100) END, '—') AS shown
FROM s, {_values(TREND)}
"""
_SQL["trend_without_contact"] = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS period, {SUMS} FROM treated GROUP BY 1)
SELECT 'Overall' AS series, period, v.metric, CASE WHEN v.metric <> 'Contact Rate' THEN {_r('v."value"')} END AS "value"
FROM s, {_values(TREND)}
"""
# without a total revenue the ratios take 0, the total takes the order value
_SQL["trend_without_revenue"] = f"""
WITH {CALLS}, s AS (SELECT {_bucket('week')} AS period, {SUMS} FROM treated GROUP BY 1)
SELECT 'Overall' AS series, period, v.metric,
       {_r("CASE WHEN v.metric LIKE 'Rev / %' THEN v.\"value\" * 0 ELSE v.\"value\" END")} AS "value"
FROM s, {_values(TREND)}
"""
_SQL["rollup_trend_without_contact"] = _SQL["trend_without_contact"]
_SQL["rollup_trend_without_revenue"] = _SQL["trend_without_revenue"]
# without orders and credit calls: what is divided by them, or counts them, is unknown; the funnel counts zero
_SQL["rollup_snapshot_without_orders"] = f"""
WITH {CALLS}, s AS (SELECT center_location AS category, {SUMS} FROM treated WHERE center_location IS NOT NULL GROUP BY 1),
t AS (SELECT category, v.metric, {_r('v."value"')} AS "value" FROM s, {_values(TREND)})
SELECT category, metric, CASE WHEN metric NOT IN ('Net Conversion', 'Top Product Mix', 'Rev / Order', 'Credit Rate', 'Passed Credit Rate')
  THEN "value" END AS "value" FROM t
UNION ALL SELECT category, 'funnel NC', CASE WHEN "value" > 0 THEN 0.0::DOUBLE END FROM t WHERE metric = 'Calls'
UNION ALL SELECT category, 'funnel CiCredit', CASE WHEN "value" > 0 THEN 0.0::DOUBLE END FROM t WHERE metric = 'Calls'
UNION ALL SELECT category, 'funnel PCR', NULL FROM t WHERE metric = 'Calls'
"""
_SQL["week_cards_without_revenue"] = _CARDS.replace("SELECT age, week, v.* FROM", """
  SELECT age, week, v."position", v.metric, CASE WHEN v.metric LIKE 'Rev%' THEN v."value" * 0 ELSE v."value" END AS "value" FROM""") + f"""
SELECT "position", metric, week, prior_week, {_r('v1')} AS "value", {_r('v2')} AS prior_value,
       {_r("CASE WHEN v2 <> 0 THEN (v1 / v2 - 1) * 100.0::DOUBLE END")} AS change_pct FROM cards
"""

# --- agents ---------------------------------------------------------------------


def _scorecard(source: str) -> str:
    def mode(column: str) -> str:
        return f"""(SELECT agent_name, {column} AS v FROM {source} WHERE {column} IS NOT NULL GROUP BY agent_name, {column}
          QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY count(*) DESC, {column}) = 1)"""

    return f"""
s AS (SELECT agent_name, {SUMS} FROM {source} WHERE agent_name IS NOT NULL GROUP BY 1),
card AS (
  SELECT s.agent_name AS agent, n AS calls, mc.v AS center, mm.v AS membership, mt.v AS tenure,
         {_div('orders', 'n')} AS net_conv, {_div('tp', 'orders')} AS top_product_mix,
         CAST(revenue AS DOUBLE) AS total_revenue, {_div('revenue', 'n')} AS rev_per_call,
         {_div('revenue', 'orders')} AS rev_per_order, talk AS talk_time, sold AS sold_talk_time
  FROM s LEFT JOIN {mode('center_location')} mc USING (agent_name)
  LEFT JOIN {mode('membership')} mm USING (agent_name)
  LEFT JOIN {mode('tenure_bucket')} mt USING (agent_name))
"""


_CARD_COLUMNS = "agent, calls, center, membership, tenure, " + ", ".join(
    f"{_r(c)} AS {c}" for c in (
        "net_conv", "top_product_mix", "total_revenue", "rev_per_call", "rev_per_order", "talk_time", "sold_talk_time"))
_SQL["agent_scorecard"] = f"WITH {CALLS}, {_scorecard('treated')} SELECT {_CARD_COLUMNS} FROM card"
_SQL["agent_scorecard_all_members"] = f"WITH {CALLS}, {_scorecard('calls')} SELECT {_CARD_COLUMNS} FROM card"
_SQL["agent_search"] = f"""
WITH {CALLS}, found AS (SELECT * FROM treated WHERE regexp_matches(agent_name, 'customer#0+[1-4]*7$', 'i')),
{_scorecard('found')} SELECT {_CARD_COLUMNS} FROM card
"""
_SQL["agent_shown"] = f"""
WITH {CALLS}, {_scorecard('treated')}
SELECT agent, format('{{:,}}', calls) AS calls, center, membership, tenure,
       coalesce(format('{{:.1f}}%', net_conv * 100), '—') AS net_conv,
       coalesce(format('{{:.1f}}%', top_product_mix * 100), '—') AS top_product_mix,
       coalesce(format('${{:,.2f}}', total_revenue), '—') AS total_revenue,
       coalesce(format('${{:,.2f}}', rev_per_call), '—') AS rev_per_call,
       coalesce(format('${{:,.2f}}', rev_per_order), '—') AS rev_per_order,
       coalesce(format('{{:.1f}}', talk_time), '—') AS talk_time,
       coalesce(format('{{:.1f}}', sold_talk_time), '—') AS sold_talk_time
FROM card
"""
_SQL["roster_shown"] = f"""
WITH {CALLS}, {_scorecard('treated')}
SELECT format('{{:,}}', count(*)) AS agents, format('{{:.1f}}%', avg(net_conv) * 100) AS avg_net_conv,
       format('${{:,.2f}}', avg(rev_per_call)) AS avg_rev_per_call, format('{{:.1f}} min', avg(talk_time)) AS avg_talk_time
FROM card
"""
_SQL["roster_summary"] = f"""
WITH {CALLS}, {_scorecard('treated')}
SELECT count(*) AS agents, {_r('avg(net_conv)')} AS avg_net_conv, {_r('avg(rev_per_call)')} AS avg_rev_per_call,
       {_r('avg(talk_time)')} AS avg_talk_time
FROM card
"""
_SQL["agent_distribution"] = f"""
WITH {CALLS}, {_scorecard('treated')},
x AS (SELECT 'net_conv' AS measure, net_conv AS x FROM card UNION ALL SELECT 'rev_per_call', rev_per_call FROM card),
span AS (SELECT measure, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1),
binned AS (
  SELECT measure, lo, (hi - lo) / 20 AS w,
         CASE WHEN lo = hi THEN 1 ELSE least(20, 1 + CAST(floor((x - lo) / (hi - lo) * 20) AS INTEGER)) END AS bin
  FROM x JOIN span USING (measure) WHERE x IS NOT NULL)
SELECT measure, bin, {_r('lo + (bin - 1) * w')} AS bin_from, {_r('lo + bin * w')} AS bin_to, count(*) AS agents
FROM binned GROUP BY measure, bin, lo, w
"""

# --- lift -----------------------------------------------------------------------

LIFT_SUMS = """
  count(*) AS row_count, count(*) FILTER (ib) AS n, coalesce(sum(orders) FILTER (sell), 0) AS orders,
  coalesce(sum(revenue) FILTER (sell), 0) AS revenue, coalesce(sum(minutes) FILTER (ib), 0) AS minutes,
  coalesce(sum(contact) FILTER (ib), 0) AS contact, coalesce(sum(credit) FILTER (ib), 0) AS credit,
  count(*) FILTER (ib AND passed_ind = 1) AS passed,
  count(*) FILTER (ib AND credit = 1 AND passed_ind IS DISTINCT FROM 1) AS failed,
  count(*) FILTER (ib AND passed_ind = 1 AND orders > 0) AS psold,
  count(*) FILTER (ib AND credit = 1 AND passed_ind IS DISTINCT FROM 1 AND orders > 0) AS fsold
"""


def _ratio(num: str, den: str) -> str:
    return _div(num, den, "<> 0")


KPIS = {
    "contact_rate": _ratio("contact", "n"), "credit_rate": _ratio("credit", "n"),
    "pass_credit_rate": _ratio("passed", "credit"), "pass_credit_conv": _ratio("psold", "passed"),
    "fail_credit_conv": _ratio("fsold", "failed"), "nc": _ratio("orders", "n"), "rpo": _ratio("revenue", "orders"),
    "rpnc": _ratio("revenue", "n"), "tt": _ratio("minutes", "n"),
    "cm_call": f"{_ratio('revenue', 'n')} - 0.4::DOUBLE * ({_ratio('minutes', 'n')})",
}
KPI_NAMES = {
    "contact_rate": "Contact Rate", "credit_rate": "Calls Into Credit", "pass_credit_rate": "Passed Credit Rate",
    "pass_credit_conv": "Passed Credit Conv.", "fail_credit_conv": "Failed Credit Conv.", "nc": "Net Conversion",
    "rpo": "RPO", "rpnc": "RPNC", "tt": "Talk Time", "cm_call": "CM / Call",
}
_KPI_COLUMNS = ", ".join(
    f"{_r(e)} AS {n}" for n, e in {"net_call": "n", "orders": "orders", "revenue": "revenue", **KPIS}.items())

_SQL["lift_active_weeks"] = f"""
WITH {LIFT}
SELECT post_week, week, count(*) AS baseline_rows FROM lift
WHERE period = 'pre_weekly' AND post_week IN (
  SELECT week FROM lift WHERE period = 'post' AND call_date_est BETWEEN DATE '2024-01-17' AND DATE '2024-01-28')
GROUP BY 1, 2
"""
_SQL["lift_post_bounds"] = """
SELECT min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day
FROM events WHERE ts >= TIMESTAMP '2024-01-15'
"""
_SQL["lift_kpis_by_cohort"] = f"""
WITH {LIFT}, s AS (SELECT week, cohort, {LIFT_SUMS} FROM lift WHERE period = 'post' AND cohort IS NOT NULL GROUP BY 1, 2)
SELECT week, cohort, {_KPI_COLUMNS} FROM s
"""
_SQL["lift_kpis_by_cohort_and_mover"] = f"""
WITH {LIFT}, s AS (
  SELECT week, cohort, mover_switcher, {LIFT_SUMS} FROM lift WHERE period = 'post' AND cohort IS NOT NULL GROUP BY 1, 2, 3)
SELECT week, cohort, mover_switcher, {_KPI_COLUMNS} FROM s
"""
_SQL["lift_fixed_baseline"] = f"""
WITH {LIFT}, s AS (
  SELECT fixed_cohort AS cohort, call_type, {LIFT_SUMS} FROM lift
  WHERE period = 'pre' AND fixed_cohort IS NOT NULL
    AND call_date_est BETWEEN DATE '2024-01-03' AND DATE '2024-01-12'
  GROUP BY 1, 2)
SELECT cohort, call_type, {_KPI_COLUMNS} FROM s
"""


def _cell_joins(keys: str, how: str, where: str = "true") -> str:
    """The four cells of every week side by side, each summed on its own."""
    def cell(name: str, period: str, week: str, cohort: str) -> str:
        extra = f", {keys}" if keys else ""
        return f"""
{name} AS (
  SELECT wk{extra}, v.*, n, row_count FROM (
    SELECT {week} AS wk{extra}, {LIFT_SUMS} FROM lift
    WHERE period = '{period}' AND cohort = '{cohort}' AND ({where}) GROUP BY ALL) s, {_values(KPIS)})"""

    using = "USING (wk, metric" + (f", {keys}" if keys else "") + ")"
    extra = f", {keys}" if keys else ""
    return ",".join([
        cell("post_t", "post", "week", "treatment"), cell("post_c", "post", "week", "control"),
        cell("pre_t", "pre_weekly", "post_week", "treatment"), cell("pre_c", "pre_weekly", "post_week", "control"),
    ]) + f""",
cells AS (
  SELECT wk, metric{extra}, post_t."position" AS p, post_t."value" AS post_treatment, post_c."value" AS post_control,
         pre_t."value" AS pre_treatment, pre_c."value" AS pre_control, post_t.n + post_c.n AS weight,
         CASE WHEN post_c."value" <> 0 THEN post_t."value" / post_c."value" - 1 END AS post_delta,
         CASE WHEN pre_c."value" <> 0 THEN pre_t."value" / pre_c."value" - 1 END AS pre_delta
  FROM post_t {how} JOIN post_c {using} {how} JOIN pre_t {using} {how} JOIN pre_c {using})
"""


_WEEKLY_COLUMNS = ", ".join(f"{_r(c)} AS {c}" for c in (
    "pre_treatment", "pre_control", "pre_delta", "post_treatment", "post_control", "post_delta")) + (
    f", {_r('post_delta - pre_delta')} AS swing")
_SQL["lift_weekly"] = f"""
WITH {LIFT}, {_cell_joins('', 'INNER')} SELECT wk AS week, metric, weight, {_WEEKLY_COLUMNS} FROM cells
"""
_SQL["lift_weekly_windowed"] = f"""
WITH {LIFT}, {_cell_joins('', 'INNER', '''mover_switcher IN ('mover', 'switcher') AND call_type = 'Site Session'
  AND (period <> 'post' OR call_date_est BETWEEN DATE '2024-01-17' AND DATE '2024-01-28')''')}
SELECT wk AS week, metric, weight, {_WEEKLY_COLUMNS} FROM cells
"""
_SQL["lift_weekly_from_table"] = _SQL["lift_weekly_windowed"]
_SQL["lift_weekly_excluding"] = f"""
WITH {LIFT}, {_cell_joins('', 'INNER')}
SELECT wk AS week, metric, weight, {_WEEKLY_COLUMNS} FROM cells WHERE wk <> '01/22/2024'
"""
_SQL["lift_volume"] = f"""
WITH {LIFT}, {_cell_joins('', 'INNER')}
SELECT count(*) AS week_count, CAST(sum(weight) AS BIGINT) AS total_weight FROM cells WHERE metric = 'nc'
"""


def _average(c: str) -> str:
    return f"sum({c} * weight) FILTER ({c} IS NOT NULL) / nullif(sum(weight) FILTER ({c} IS NOT NULL), 0)"


_NAME = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in KPI_NAMES.items()) + " END"
_SUMMARY = f"""
WITH {LIFT}, {_cell_joins('', 'INNER')},
w AS (SELECT *, post_delta - pre_delta AS swing FROM cells),
summary AS (SELECT p AS "position", metric, {_NAME} AS name, """ + ", ".join(
    f"{_average(c)} AS {c}" for c in (
        "pre_treatment", "pre_control", "pre_delta", "post_treatment", "post_control", "post_delta", "swing")) + """
  FROM w GROUP BY 1, 2)
"""
_SQL["lift_summary"] = _SUMMARY + 'SELECT "position", metric, name, ' + ", ".join(
    f"{_r(c)} AS {c}" for c in (
        "pre_treatment", "pre_control", "pre_delta", "post_treatment", "post_control", "post_delta", "swing")
) + " FROM summary"


def _kpi_text(c: str) -> str:
    return f"""coalesce(CASE WHEN {c} IS NULL THEN NULL WHEN metric = 'tt' THEN format('{{:.2f}}', {c})
      WHEN metric IN ('rpo', 'rpnc', 'cm_call') THEN format('${{:,.1f}}', {c})
      ELSE format('{{:.1f}}%', {c} * 100) END, '—') AS {c}_shown"""


def _delta_text(c: str) -> str:
    return f"coalesce(CASE WHEN {c} > 0 THEN '+' ELSE '' END || format('{{:.1f}}%', {c} * 100), '—') AS {c}_shown"


def _delta_class(c: str) -> str:
    shown = f"CAST(format('{{:.1f}}', {c} * 100) AS DOUBLE)"
    return f"""CASE WHEN {c} IS NULL THEN NULL WHEN abs({shown}) < 1.5 THEN 'neutral'
      WHEN ({shown} > 0) = (metric <> 'tt') THEN 'better' ELSE 'worse' END AS {c}_class"""


_SQL["lift_summary_shown"] = _SUMMARY + 'SELECT "position", name, ' + ", ".join(
    [_kpi_text(c) for c in ("pre_treatment", "pre_control", "post_treatment", "post_control")]
    + [_delta_text(c) for c in ("pre_delta", "post_delta", "swing")]
    + [_delta_class(c) for c in ("pre_delta", "post_delta", "swing")]) + " FROM summary"
_SQL["lift_headlines"] = _SUMMARY + f"""
SELECT CASE metric WHEN 'rpnc' THEN 1 WHEN 'nc' THEN 2 WHEN 'rpo' THEN 3 WHEN 'credit_rate' THEN 4 ELSE 5 END AS "position",
       metric, {_r('swing')} AS swing, {_r('post_delta')} AS post_delta
FROM summary WHERE metric IN ('rpnc', 'nc', 'rpo', 'credit_rate', 'tt')
"""

_SQL["lift_headlines_shown"] = _SUMMARY + """
SELECT CASE metric WHEN 'rpnc' THEN 1 WHEN 'nc' THEN 2 WHEN 'rpo' THEN 3 WHEN 'credit_rate' THEN 4 ELSE 5 END AS "position",
       metric, coalesce(CASE WHEN swing > 0 THEN '+' ELSE '' END || format('{:.1f}pp swing', swing * 100), '—') AS swing_shown,
       'Post Δ: ' || CASE WHEN post_delta > 0 THEN '+' ELSE '' END || format('{:.1f}pp', post_delta * 100) AS post_shown
FROM summary WHERE metric IN ('rpnc', 'nc', 'rpo', 'credit_rate', 'tt')
"""

for _name, _column in {"": "", **LIFT_DIMENSIONS}.items():
    _suffix = f"_by_{_name}" if _name else ""
    _series = f"{_column} || ' — ' || " if _name else ""
    _week = "CAST(strptime(wk, '%m/%d/%Y') AS DATE) AS week_start"
    _cells = f"WITH {LIFT}, {_cell_joins(_column, 'LEFT')}"
    _SQL[f"lift_trend_raw{_suffix}"] = _cells + f"""
SELECT {_series}'treatment' AS series, {_week}, metric, {_r('"value"')} AS "value" FROM post_t
UNION ALL SELECT {_series}'control', {_week}, metric, {_r('"value"')} FROM post_c
"""
    _SQL[f"lift_trend_post_delta{_suffix}"] = _cells + f"""
SELECT {_series}'treatment' AS series, {_week}, metric, {_r('post_delta')} AS "value" FROM cells
"""
    _SQL[f"lift_trend_swing{_suffix}"] = _cells + f"""
SELECT {_series}'treatment' AS series, {_week}, metric, {_r('post_delta - pre_delta')} AS "value" FROM cells
"""

_SQL["lift_files"] = f"""
WITH {LIFT}
SELECT period, week, post_week, cohort, count(*) AS fact_rows,
       round(CAST(sum(CASE WHEN orders <> 5 THEN CAST(revenue AS DOUBLE) END) AS DOUBLE) + 1e-9::DOUBLE, 2) AS revenue,
       CAST(sum(orders) AS DOUBLE) AS order_count, CAST(sum(passed_ind) AS DOUBLE) AS passed_count,
       max(call_time_est) AS last_call
FROM lift GROUP BY 1, 2, 3, 4
"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
