"""Overview and agent reports on hand-made calls."""

from __future__ import annotations

from datetime import date

import pytest

from dialtone.config import CallFilters, Labels
from dialtone.functions import formats
from dialtone.operators import filters
from dialtone.operators.measures import daily_rollup
from dialtone.plans import agents, overview
from checks import adapter
from tests.helpers import by, calls


def value(rows: dict, metric: str):
    return rows[metric]["value"]


def test_scopes_and_missing_direction(spark):
    some = calls(spark, dict(call_direction="inbound", orders=1), dict(call_direction="Manual_Outbound", orders=2),
                 dict(call_direction="OUTBOUND", orders=4), dict(call_direction=None, orders=8))
    row = overview.kpi_totals(some).first()
    assert (row.n_calls, row.net_conversion) == (1, 3)
    # without a direction every call counts, or those flagged as inbound
    bare = some.drop("call_direction")
    row = overview.kpi_totals(bare).first()
    assert (row.n_calls, row.net_conversion) == (4, 15 / 4)
    flagged = bare.selectExpr("*", "if(orders = 2, 1, NULL) AS ibcalls")
    row = overview.kpi_totals(flagged).first()
    assert (row.n_calls, row.net_conversion) == (1, 15)


def test_missing_columns_count_as_nothing(spark):
    bare = calls(spark, dict(gcv_fo=10)).drop("total_revenue", "talk_time_minutes", "credit_calls_flag", "orders")
    row = overview.kpi_totals(bare).first()
    assert (row.total_revenue, row.credit_rate, row.talk_time, row.net_conversion) == (10, 0, None, 0)
    assert row.rev_per_order is None


def test_funnel_and_trend_differ_in_scope(spark):
    some = calls(spark, dict(orders=1, tpsales_flag=1), dict(call_direction="MANUAL_OUTBOUND", orders=3, tpsales_flag=1))
    funnel = by(overview.funnel_long(some, "Weekly"), "metric")
    trend = by(overview.trend(some, "Weekly"), "metric")
    assert (value(funnel, "NC"), value(trend, "Net Conversion")) == (4, 1)
    assert (value(funnel, "TPM"), value(trend, "Top Product Mix")) == (0.5, 1)


def test_talk_time_is_a_mean_over_known_times(spark):
    some = calls(spark, dict(talk_time_minutes=3.0, orders=1), dict(talk_time_minutes=1.0), dict(talk_time_minutes=None))
    funnel = by(overview.funnel_long(some, "Daily"), "metric")
    assert [value(funnel, m) for m in ("Calls", "Talk Time", "Sold Talk Time", "Unsold Talk Time")] == [3, 2, 3, 1]


def test_rates_without_denominator_are_missing(spark):
    funnel = by(overview.funnel_long(calls(spark, dict(call_direction="OUTBOUND")), "Daily"), "metric")
    assert value(funnel, "Calls") == 0 and value(funnel, "Revenue") == 0
    assert [value(funnel, m) for m in ("NC", "PCC", "RPO", "Talk Time")] == [None] * 4
    assert funnel["NC"]["shown"] == "—"


def test_periods_over_a_year_boundary_stay_apart(spark):
    some = calls(spark, dict(call_date_est=date(2023, 1, 2)), dict(call_date_est=date(2024, 1, 2)), dict(call_date_est=None))
    rows = overview.funnel_long(some, "Daily").filter("metric = 'Calls'").collect()
    assert [(r.period, r.label, r.value) for r in rows] == [
        (date(2023, 1, 2), "Jan 02", 1), (date(2024, 1, 2), "Jan 02", 1)]
    assert overview.funnel_table(some, "Daily", shown=True).columns == ["position", "metric", "2023-01-02", "2024-01-02"]


@pytest.mark.parametrize("granularity, start, label", [
    ("Daily", date(2024, 3, 3), "Mar 03"), ("Weekly", date(2024, 2, 26), "Feb 26"), ("Monthly", date(2024, 3, 1), "Mar 2024")])
def test_period_start(spark, granularity, start, label):
    row = overview.funnel_long(calls(spark, dict(call_date_est=date(2024, 3, 3))), granularity).first()
    assert (row.period, row.label) == (start, label)


def test_prior_week_is_the_previous_one_with_calls(spark):
    some = calls(spark, dict(call_date_est=date(2024, 1, 1), total_revenue=10), dict(call_date_est=date(2024, 1, 24), total_revenue=15))
    card = by(overview.week_cards(some), "metric")["Rev / Call"]
    assert (card["week"], card["prior_week"]) == (date(2024, 1, 22), date(2024, 1, 1))
    assert (card["value"], card["prior_value"], card["change_pct"]) == (15, 10, 50)
    shown = by(overview.show_week_cards(overview.week_cards(some)), "metric")
    assert (shown["Rev / Call"]["shown"], shown["Rev / Call"]["delta"]) == ("$15.00", "+50.0% vs prior wk")
    assert (shown["Net Conversion"]["shown"], shown["Net Conversion"]["delta"]) == ("—", None)


def test_single_week_has_no_prior(spark):
    card = by(overview.week_cards(calls(spark, dict(total_revenue=10))), "metric")["Rev / Call"]
    assert (card["value"], card["prior_week"], card["prior_value"], card["change_pct"]) == (10, None, None, None)


def test_overlapping_periods_count_a_call_twice(spark):
    days = [dict(call_date_est=date(2024, 1, d), total_revenue=d) for d in (1, 2, 3)]
    compared = by(overview.compare_periods(
        calls(spark, *days), (date(2024, 1, 1), date(2024, 1, 2)), (date(2024, 1, 3), date(2024, 1, 2))), "metric")
    assert (compared["Revenue"]["first_value"], compared["Revenue"]["second_value"]) == (3, 5)
    assert compared["Calls"]["change_pct"] == 0 and compared["Calls"]["change_class"] == "neutral"
    assert compared["NC"]["change_pct"] is None and compared["NC"]["change_class"] is None


def test_empty_and_incomplete_periods(spark):
    some = calls(spark, dict(total_revenue=5))
    compared = by(overview.compare_periods(some, (date(2020, 1, 1), date(2020, 1, 2)), (date(2024, 1, 1),)), "metric")
    assert (compared["Calls"]["first_value"], compared["Calls"]["second_value"]) == (0, 0)
    assert filters.period_slice(some, "call_date_est", [date(2024, 1, 1)]).count() == 0


def test_missing_group_counts_in_overall_only(spark):
    some = calls(spark, dict(center_location="N"), dict(center_location=None), dict(center_location="N"))
    rows = overview.trend(some, "Weekly", ["Calls"], "center_location").collect()
    assert [(r.series, r.value) for r in rows] == [("N", 2), ("Overall", 3)]
    assert [(r.category, r.value) for r in overview.snapshot(some, ["Calls"], "center_location").collect()] == [("N", 2)]
    with pytest.raises(KeyError):
        overview.trend(some, metrics=["No such metric"])


def test_snapshot_is_best_first_and_missing_last(spark):
    some = calls(spark, dict(center_location="A", total_revenue=1), dict(center_location="B", total_revenue=9),
                 dict(center_location="C", call_direction="OUTBOUND"))
    rows = overview.snapshot(some, ["Rev / Call"], "center_location").collect()
    assert [(r.category, r.value) for r in rows] == [("B", 9), ("A", 1), ("C", None)]


def test_reports_read_a_rollup_like_the_calls(spark, sf_dir):
    raw = adapter.calls(spark, sf_dir)
    rolled = daily_rollup(raw)
    picked = CallFilters(start=date(2024, 1, 3), end=date(2024, 1, 25), center_location=("ASIA", "AFRICA"))

    def shown(df):
        df = filters.apply_call_filters(df, picked)
        return [
            [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in report.collect()]
            for report in (
                overview.funnel_long(df, "Weekly"), overview.week_cards(df), overview.kpi_totals(df),
                overview.trend(df, "Weekly", None, "tenure_bucket"), overview.snapshot(df, None, "call_type"),
                agents.sort_agents(agents.agent_scorecard(df)),
                overview.compare_periods(df, (date(2024, 1, 3), date(2024, 1, 9)), (date(2024, 1, 8), date(2024, 1, 20))),
            )]

    assert shown(raw) == shown(rolled)


def test_treatment_label_is_a_parameter(spark):
    some = calls(spark, dict(membership="new"), dict(membership="old"))
    assert filters.treatment_only(some, Labels("new", "old")).count() == 1
    assert filters.treatment_only(some.drop("membership")).count() == 2


def test_search_is_a_case_insensitive_pattern(spark):
    some = calls(spark, dict(agent_name="Ann Lee"), dict(agent_name="Bob"), dict(agent_name=None))
    assert [r.agent_name for r in filters.name_matches(some, "agent_name", "^ann|z").collect()] == ["Ann Lee"]
    assert filters.name_matches(some, "agent_name", "").count() == 3


def test_modes_take_the_smallest_of_equals_and_skip_missing(spark):
    some = calls(
        spark,
        dict(agent_name="A", center_location="X", tenure_bucket=None), dict(agent_name="A", center_location="W", tenure_bucket=None),
        dict(agent_name="B", center_location="X"), dict(agent_name="B", center_location=None, tenure_bucket="Early"),
        dict(agent_name="B", center_location=None), dict(agent_name=None))
    card = by(agents.agent_scorecard(some), "agent")
    assert set(card) == {"A", "B"}
    assert (card["A"]["center"], card["A"]["tenure"], card["A"]["calls"]) == ("W", None, 2)
    assert (card["B"]["center"], card["B"]["tenure"], card["B"]["membership"]) == ("X", "Vet", "treatment")
    bare = agents.agent_scorecard(some.drop("tenure_bucket", "center_location")).first()
    assert (bare.center, bare.tenure, bare.membership) == ("—", "—", "treatment")


def test_agent_order_puts_missing_last_either_way(spark):
    some = calls(spark, dict(agent_name="A", total_revenue=1), dict(agent_name="B", total_revenue=2),
                 dict(agent_name="C", call_direction="OUTBOUND"))
    card = agents.agent_scorecard(some)
    for ascending, order in ((True, "ABC"), (False, "BAC")):
        assert "".join(r.agent for r in agents.sort_agents(card, "Rev / Call", ascending).collect()) == order


def test_roster_summary_is_an_unweighted_mean(spark):
    some = calls(spark, *[dict(agent_name="A", orders=1)] * 3, dict(agent_name="B"), dict(agent_name="C", call_direction="OUTBOUND"))
    row = agents.roster_summary(agents.agent_scorecard(some)).first()
    assert (row.agents, row.avg_net_conv) == (3, 0.5)


def test_distribution_bins(spark):
    some = calls(spark, *[dict(agent_name=f"A{i}", orders=i, total_revenue=7) for i in range(0, 41, 2)])
    bins = agents.agent_distribution(agents.agent_scorecard(some)).collect()
    conv = [r for r in bins if r.measure == "net_conv"]
    assert [r.agents for r in conv] == [1] * 19 + [2]          # the largest value joins the last bin
    assert (conv[0].bin_from, conv[-1].bin_to) == (0, 40)
    assert [(r.bin, r.agents) for r in bins if r.measure == "rev_per_call"] == [(1, 21)]


@pytest.mark.parametrize("metric, pct, expected", [
    ("NC", 1.44, "neutral"), ("NC", 1.46, "better"), ("NC", -1.5, "worse"), ("Talk Time", -2.0, "better"),
    ("tt", 2.0, "worse"), ("NC", None, None), ("NC", float("inf"), None), ("NC", float("nan"), None)])
def test_change_class(spark, metric, pct, expected):
    df = spark.createDataFrame([(metric, pct)], "metric STRING, pct DOUBLE")
    assert df.selectExpr(formats.change_class("metric", "pct") + " AS c").first().c == expected


@pytest.mark.parametrize("value_, kind, expected", [
    (1234.0, "count", "1,234"), (0.1225, "pct", "12.2%"), (1234.5, "dollar", "$1,234.50"), (-3.0, "dollar", "$-3.00"),
    (2.345, "decimal", f"{2.345:.2f}"), (None, "pct", "—")])
def test_display(spark, value_, kind, expected):
    df = spark.createDataFrame([(value_, kind)], "v DOUBLE, k STRING")
    assert df.selectExpr(formats.display("v", "k") + " AS t").first().t == expected


def test_default_windows_are_clamped_to_the_data(spark):
    def window(*days):
        df = calls(spark, *[dict(call_date_est=date(2024, 1, d)) for d in days])
        return tuple(filters.default_window(df).first()), tuple(x.day for x in filters.default_comparison(df).first())

    assert window(1, 31) == ((date(2024, 1, 25), date(2024, 1, 31)), (18, 24, 25, 31))
    assert window(1, 10) == ((date(2024, 1, 4), date(2024, 1, 10)), (1, 3, 4, 10))
    assert window(1, 4) == ((date(2024, 1, 1), date(2024, 1, 4)), (1, 4, 1, 4))


def test_filter_options_and_bounds(spark):
    some = calls(spark, dict(center_location="N"), dict(center_location=None, call_type="Permalease"))
    options = [(r.dimension, r.value) for r in filters.filter_options(some, ("center_location", "call_type", "absent")).collect()]
    assert options == [("call_type", "Permalease"), ("call_type", "Site Session"), ("center_location", "N")]


def test_same_period_twice_changes_by_nothing(spark, sf_dir):
    week = (date(2024, 1, 8), date(2024, 1, 14))
    for r in overview.compare_periods(adapter.calls(spark, sf_dir), week, week).collect():
        assert r.change_pct == (None if not r.first_value else 0)


def test_groups_add_up_to_overall(spark, sf_dir):
    rows = overview.trend(adapter.calls(spark, sf_dir), "Weekly", ["Calls"], "Call Type").collect()
    for period in {r.period for r in rows}:
        of = [r for r in rows if r.period == period]
        assert sum(r.value for r in of if not r.is_overall) == sum(r.value for r in of if r.is_overall) > 0


def test_rollup_knows_which_columns_its_calls_had(spark):
    df = calls(spark, dict(ib_contact_calls=1, orders=2, total_revenue=10), dict(ib_contact_calls=0, orders=0))
    for absent, unknown in (("ib_contact_calls", {"Contact Rate"}), ("orders", {"Net Conversion", "Top Product Mix", "Rev / Order"}),
                            ("credit_calls_flag", {"Credit Rate", "Passed Credit Rate"})):
        less = df.drop(absent)
        rollup = daily_rollup(less)
        again = daily_rollup(rollup)
        for source in (less, rollup, again):
            values = {r.metric: r.value for r in overview.trend(source).collect()}
            assert unknown <= {m for m, v in values.items() if v is None}, (absent, source.columns)
        assert overview.funnel(rollup).collect() == overview.funnel(less).collect()
        assert overview.kpi_totals(again).collect() == overview.kpi_totals(less).collect()
    kept = {r.metric: r.value for r in overview.trend(daily_rollup(df)).collect()}
    assert kept["Contact Rate"] == 0.5 and kept["Net Conversion"] == 1.0


def test_found_periods_need_one_reading_of_the_calls(spark, tmp_path):
    from checks.session import test_folder
    test_folder(spark, "x")
    calls(spark, dict(), dict(call_date_est=date(2024, 1, 9))).write.parquet(str(tmp_path / "calls"))
    table = overview.funnel_table(spark.read.parquet(str(tmp_path / "calls")), "Weekly")
    assert table.columns == ["position", "metric", "2024-01-01", "2024-01-08"]
    assert f"{tmp_path}/calls" not in table._jdf.queryExecution().executedPlan().toString()
