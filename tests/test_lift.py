"""Lift reports on hand-made facts."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from dialtone.config import CallFilters, Labels, LiftCentre, LiftWindow
from dialtone.plans import lift
from tests.helpers import by, lift_facts

W1, W2 = "01/15/2024", "01/22/2024"


def cell(period, cohort, week=W1, **more):
    where = dict(week=week, post_week=None) if period == "post" else dict(week="01/01/2024", post_week=week)
    return dict(period=period, cohort=cohort, **where, **more)


def four(week=W1, values=(1, 2, 3, 4), **more):
    cells = (("pre_weekly", "treatment"), ("pre_weekly", "control"), ("post", "treatment"), ("post", "control"))
    return [cell(p, c, week, gcv_revenue=float(v), **more) for (p, c), v in zip(cells, values)]


def weekly(spark, *rows, **options):
    return lift.weekly_lift(lift.weekly_scope(lift_facts(spark, *rows), **options))


def test_kpis(spark):
    facts = lift_facts(
        spark,
        dict(talk_time_minutes=6.0, gcv_revenue=10.0, order_orders=2.0, credit_calls_ind=1.0, passed_credit_call_ind=1.0),
        dict(talk_time_minutes=None, credit_calls_ind=1.0, passed_credit_call_ind=None, order_orders=1.0, gcv_revenue=2.0),
        dict(credit_calls_ind=1.0, passed_credit_call_ind=0.0),
        dict(call_direction="MANUAL_OUTBOUND", gcv_revenue=12.0, order_orders=3.0, talk_time_minutes=50.0),
        dict(call_direction="OUTBOUND", gcv_revenue=99.0))
    k = lift.lift_kpis(facts).first()
    assert (k.net_call, k.orders, k.revenue) == (3, 6, 24)
    assert (k.tt, k.rpnc, k.rpo, k.nc) == (2, 8, 4, 2)             # minutes per call, not per known time
    assert k.cm_call == pytest.approx(8 - 0.4 * 2)
    assert (k.pass_credit_rate, k.pass_credit_conv) == (pytest.approx(1 / 3), 1)
    assert k.fail_credit_conv == 0.5                               # an unknown outcome has failed here


def test_rates_guard_against_zero_only(spark):
    k = lift.lift_kpis(lift_facts(spark, dict(gcv_revenue=6.0, order_orders=-2.0), dict(call_direction="OUTBOUND"))).first()
    assert (k.rpo, k.nc, k.contact_rate, k.fail_credit_conv) == (-3, -2, 0, None)
    assert lift.lift_kpis(lift_facts(spark, dict(call_direction="OUTBOUND"))).first().rpnc is None


def test_week_needs_rows_in_all_four_cells(spark):
    out = by(weekly(spark, *four(), *four(W2)[:3]), "week", "metric")
    assert {w for w, _ in out} == {W1}
    rpnc = out[W1, "rpnc"]
    assert (rpnc["pre_delta"], rpnc["post_delta"], rpnc["swing"], rpnc["weight"]) == (-0.5, -0.25, 0.25, 2)
    assert out[W1, "rpo"]["post_delta"] is None


def test_cell_without_inbound_calls_still_counts(spark):
    out = by(weekly(spark, *four(call_direction="OUTBOUND")), "metric")
    assert (out["rpnc"]["weight"], out["rpnc"]["swing"]) == (0, None)
    facts = weekly(spark, *four(call_direction="OUTBOUND"))
    assert tuple(lift.lift_volume(facts).first()) == (1, 0)
    assert by(lift.lift_summary(facts), "metric")["rpnc"]["post_treatment"] is None


def test_averages_leave_out_missing_weeks_per_column(spark):
    # in the second week the baseline control has no revenue, so it has no pre delta
    rows = [*four(), *four(W2, (1, 0, 8, 4)), cell("post", "treatment", W2, gcv_revenue=8.0)]
    facts = weekly(spark, *rows)
    s = by(lift.lift_summary(facts), "metric")["rpnc"]
    assert tuple(lift.lift_volume(facts).first()) == (2, 5)
    assert s["post_delta"] == pytest.approx((-0.25 * 2 + 1.0 * 3) / 5)
    assert s["pre_delta"] == -0.5 and s["swing"] == 0.25
    assert s["swing"] != pytest.approx(s["post_delta"] - s["pre_delta"])


def test_summary_has_all_kpis_without_any_week(spark):
    summary = lift.lift_summary(weekly(spark, cell("post", "treatment")))
    rows = summary.collect()
    assert [r.position for r in rows] == list(range(1, 11)) and all(r.swing is None for r in rows)
    heads = lift.show_headlines(lift.lift_headlines(summary)).collect()
    assert [(r.metric, r.swing_shown, r.post_shown) for r in heads][:2] == [("rpnc", "—", None), ("nc", "—", None)]


def test_shown_texts(spark):
    summary = lift.lift_summary(weekly(spark, *four(talk_time_minutes=3.0)))
    row = by(lift.show_summary(summary), "name")
    assert (row["RPNC"]["post_control_shown"], row["RPNC"]["swing_shown"], row["RPNC"]["swing_class"]) == ("$4.0", "+25.0%", "better")
    assert (row["Talk Time"]["post_control_shown"], row["Talk Time"]["swing_shown"], row["Talk Time"]["swing_class"]) == ("3.00", "0.0%", "neutral")
    heads = by(lift.show_headlines(lift.lift_headlines(summary)), "metric")
    assert (heads["rpnc"]["swing_shown"], heads["rpnc"]["post_shown"]) == ("+25.0pp swing", "Post Δ: -25.0pp")


def test_labels_are_parameters(spark):
    rows = [{**r, "cohort": {"treatment": "new", "control": "old"}[r["cohort"]]} for r in four()]
    scope = lift.weekly_scope(lift_facts(spark, *rows))
    assert lift.weekly_lift(scope).count() == 0
    assert lift.weekly_lift(scope, Labels("new", "old")).count() == 10
    assert {r.series for r in lift.lift_trend(scope, labels=Labels("new", "old")).collect()} == {"new", "old"}


def test_excluding_a_week_keeps_rows_without_week(spark):
    facts = lift_facts(spark, *four(), *four(W2), cell("post", "treatment", None))
    scope = lift.weekly_scope(facts, LiftWindow(date(2024, 1, 1), date(2024, 1, 2), excluded_week=W2))
    assert {r.week_key for r in scope.collect()} == {W1, None}


def test_window_and_filters(spark):
    late = dict(call_datetime_est=datetime(2024, 1, 20, 23, 59))
    facts = lift_facts(spark, *four(mover_switcher="mover"), *[{**r, **late} for r in four(W2, mover_switcher="switcher")])
    window = LiftWindow(date(2024, 1, 1), date(2024, 1, 2), post_from=date(2024, 1, 17), post_to=date(2024, 1, 20))
    assert {r.week for r in lift.weekly_lift(lift.weekly_scope(facts, window)).collect()} == {W2}
    chosen = CallFilters(mover_switcher=("mover",), center_location=("ignored here",))
    assert {r.week for r in lift.weekly_lift(lift.weekly_scope(facts, None, chosen)).collect()} == {W1}
    assert [r.week for r in lift.active_weeks(facts, window.post_from, window.post_to).collect()] == [W2]
    # baselines of weeks that the window leaves out are gone before anything is added up
    assert {r.week_key for r in lift.weekly_scope(facts, window).collect()} == {W2}
    turned = LiftWindow(date(2024, 1, 1), date(2024, 1, 2), post_from=date(2024, 1, 20), post_to=date(2024, 1, 17))
    assert lift.weekly_scope(facts, turned).count() == 0


def test_baseline_join_changes_nothing_in_the_comparison(spark):
    facts = lift_facts(spark, *four(), *[r for r in four(W2) if r["period"] == "pre_weekly"])
    weeks = lift.active_weeks(facts)
    joined = facts.filter("period = 'post'").unionByName(
        lift.baseline_of(facts, weeks).select(*facts.columns))
    assert sorted(lift.weekly_lift(lift.weekly_scope(joined)).collect()) == sorted(
        lift.weekly_lift(lift.weekly_scope(facts)).collect())


def test_fixed_baseline_uses_its_own_cohort(spark):
    pre = dict(period="pre", call_datetime_est=datetime(2024, 1, 5, 12), gcv_revenue=4.0)
    facts = lift_facts(
        spark, dict(pre, cohort="treatment", canonical_cohort="control"), dict(pre, canonical_cohort=None),
        dict(pre, canonical_cohort="treatment", call_datetime_est=datetime(2024, 1, 9)))
    base = lift.fixed_baseline(facts, LiftWindow(date(2024, 1, 1), date(2024, 1, 8)))
    assert [(r.cohort, r.net_call, r.rpnc) for r in lift.fixed_baseline_kpis(base).collect()] == [("control", 1, 4)]
    assert lift.fixed_baseline_kpis(base, "call_type").first().call_type == "Site Session"


def test_trend_needs_only_the_post_cell(spark):
    facts = lift_facts(spark, *four(), cell("post", "treatment", W2, gcv_revenue=9.0), cell("post", "treatment", "soon"))
    scope = lift.weekly_scope(facts)

    def series(view):
        rows = lift.lift_trend(scope, view, ["rpnc"]).collect()
        return {(r.series, r.week_start.day): r.value for r in rows}

    assert series("raw") == {("treatment", 15): 3, ("control", 15): 4, ("treatment", 22): 9}
    assert series("post_delta") == {("treatment", 15): -0.25, ("treatment", 22): None}
    assert series("swing") == {("treatment", 15): 0.25, ("treatment", 22): None}
    with pytest.raises(ValueError):
        lift.lift_trend(scope, "no such view")


def test_trend_by_dimension(spark):
    facts = lift_facts(spark, *four(call_type="A"), *four(values=(2, 2, 5, 5), call_type="B"),
                       cell("post", "treatment", call_type=None, gcv_revenue=1.0))
    rows = lift.lift_trend(lift.weekly_scope(facts), "swing", ["rpnc"], "call_type").collect()
    assert [(r.series, r.value) for r in rows] == [("A — treatment", 0.25), ("B — treatment", 0.0)]


def test_no_control_at_all_gives_missing_deltas(spark):
    facts = lift_facts(spark, cell("post", "treatment", gcv_revenue=1.0), cell("pre_weekly", "treatment"))
    rows = lift.lift_trend(lift.weekly_scope(facts), "post_delta", ["rpnc"]).collect()
    assert [(r.series, r.value) for r in rows] == [("treatment", None)]


def test_week_labels_need_no_padding(spark):
    facts = lift_facts(spark, cell("post", "treatment", "1/5/2024"))
    assert lift.lift_trend(lift.weekly_scope(facts), metrics=["nc"]).first().week_start == date(2024, 1, 5)


def test_announced_post_dates_do_not_filter(spark):
    centre = LiftCentre("base", date(2024, 1, 1), date(2024, 1, 8), date(2030, 1, 1), date(2030, 2, 1))
    facts = lift_facts(spark, *four())
    assert lift.weekly_lift(lift.weekly_scope(facts, centre.window())).count() == 10
    assert lift.weekly_lift(lift.weekly_scope(facts, centre.window(post_from=date(2024, 1, 17)))).count() == 0


def test_equal_weights_give_the_plain_mean(spark):
    summary = by(lift.lift_summary(weekly(spark, *four(), *four(W2, (1, 2, 6, 4)))), "metric")
    assert summary["rpnc"]["post_delta"] == pytest.approx((-0.25 + 0.5) / 2)
