"""What the physical plans look like: nothing in Python, no all-pairs join, few scans."""

from __future__ import annotations

import re
from datetime import date

import pytest

from checks import adapter
from checks.queries import queries
from dialtone.operators import filters
from dialtone.operators.dedup import latest_version
from dialtone.plans import agents, extract, lift, overview
from tests.helpers import plan_text

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas", "CartesianProduct", "NestedLoop")


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_pair_joins(spark, sf_dir, name):
    plan = plan_text(queries()[name](spark, sf_dir))
    assert not [f for f in FORBIDDEN if f in plan]


@pytest.fixture(scope="module")
def mart(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mart"))
    adapter.calls(spark, sf_dir).write.parquet(path + "/m")
    adapter.lift(spark, sf_dir).write.parquet(path + "/l")
    return spark.read.parquet(path + "/m"), spark.read.parquet(path + "/l")


REPORTS = {
    "totals": lambda c, _: overview.kpi_totals(c),
    "funnel": lambda c, _: overview.funnel_long(c, "Weekly"),
    "cards": lambda c, _: overview.week_cards(c),
    "comparison": lambda c, _: overview.compare_periods(c, (date(2024, 1, 1), date(2024, 1, 7)), (date(2024, 1, 8), date(2024, 1, 14))),
    "trend": lambda c, _: overview.trend(c, "Weekly", None, "center_location"),
    "snapshot": lambda c, _: overview.snapshot(c, None, "center_location"),
    "agents": lambda c, _: agents.sort_agents(agents.agent_scorecard(c)),
    "options": lambda c, _: filters.filter_options(c),
    "lift": lambda _, f: lift.lift_summary(lift.weekly_lift(lift.weekly_scope(f))),
    "lift trend": lambda _, f: lift.lift_trend(lift.weekly_scope(f), "swing", None, "call_type"),
}


@pytest.mark.parametrize("name", REPORTS)
def test_a_report_reads_its_data_once(mart, name):
    plan = plan_text(REPORTS[name](*mart))
    assert plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("name", REPORTS)
def test_rows_are_added_up_before_any_shuffle(mart, name):
    """Between the scan and the first exchange there is a partial aggregation."""
    plan = plan_text(REPORTS[name](*mart))
    below = plan[: plan.index("FileScan parquet")].rsplit("Exchange", 1)[1]
    assert "HashAggregate" in below and "Expand" not in below and "Generate" not in below


def test_scan_reads_only_the_columns_in_use(mart):
    plan = plan_text(overview.trend(mart[0], "Weekly", ["Contact Rate"]))
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"call_date_est", "call_direction", "ib_contact_calls"}


def test_filters_reach_the_scan(mart):
    picked = filters.between_days(filters.treatment_only(mart[0]), "call_date_est", date(2024, 1, 5), date(2024, 1, 9))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan_text(overview.funnel(picked))).group(1)
    for part in ("EqualTo(membership,treatment)", "GreaterThanOrEqual(call_date_est,2024-01-05)",
                 "LessThanOrEqual(call_date_est,2024-01-09)"):
        assert part in pushed


def test_source_bounds_reach_the_scan(spark, sf_dir, tmp_path):
    src = adapter.extract_sources(spark, sf_dir)
    src.agent_calls.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    plan = plan_text(filters.since(facts, "call_datetime_est", date(2024, 1, 12)))
    assert "GreaterThanOrEqual(call_datetime_est,2024-01-12T00:00)" in plan
    src.orders.write.parquet(str(tmp_path / "orders"))
    from dialtone.operators.order_rollup import orders_since
    plan = plan_text(orders_since(spark.read.parquet(str(tmp_path / "orders")), date(2024, 1, 12)))
    assert "Or(GreaterThanOrEqual(order_date_est,2024-01-11T00:00)" in plan


def test_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "id AS at")
    plan = plan_text(latest_version(df, "k", "at"))
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_call_mart_without_any_broadcast(spark, sf_dir):
    """Lookups too big to broadcast are merged, and the result stays the same."""
    run = queries()["call_mart"]
    small = sorted(map(tuple, run(spark, sf_dir).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = run(spark, sf_dir)
        assert "BroadcastExchange" not in plan_text(df)
        assert sorted(map(tuple, df.collect()), key=repr) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_both_readers_of_the_anchor_input_share_its_shuffle(spark, sf_dir):
    from dialtone.operators.anchor import latest_prior_long_call
    src = adapter.extract_sources(spark, sf_dir)
    calls = extract.deduplicated_calls(extract.scoped_calls(src, adapter.EXTRACT))
    df = latest_prior_long_call(calls.select("call_id", "employeeid", "call_datetime_est", "talk_time_seconds"))
    df.collect()
    final = plan_text(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and final.count("ReusedExchange") >= 2
