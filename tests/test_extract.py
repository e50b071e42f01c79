"""The extract on hand-made inputs, one test per trap."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from checks import adapter
from checks.session import test_folder
from dialtone.config import ExtractConfig
from dialtone.operators import lookups
from dialtone.operators.anchor import anchor_calls, anchor_classes, latest_prior_long_call, pairs_of_classes
from dialtone.operators.dedup import latest_version
from dialtone.operators.lookups import repeat_rows
from dialtone.operators.order_rollup import order_rollup, orders_since
from dialtone.plans import extract
from dialtone.schemas import AGENT_CALLS, CALL_MART, ORDERS
from dialtone.sources import anchor_state
from dialtone.sources.storage import staged
from tests.helpers import by, plan_text, rows_of, sources

CFG = ExtractConfig(from_date=date(2024, 1, 1), excluded_agents=("Boss",), excluded_centers=("Closed",),
                    non_lease_numbers=("555",))
T = datetime(2024, 1, 10, 9, 0)


def call(call_id, minute=0, talk=100, **more):
    return {"call_id": call_id, "call_datetime_est": T + timedelta(minutes=minute), "employeeid": 1,
            "agent_name": "Ann", "talk_time_seconds": None if talk is None else Decimal(talk), **more}


def mart(spark, **tables):
    return extract.call_mart(sources(spark, **tables), CFG)


def test_newest_version_wins_and_missing_time_loses(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, T, "b"), (1, T, "c"), (2, None, "d")], "k BIGINT, at TIMESTAMP_NTZ, v STRING")
    assert {r.k: r.v for r in latest_version(df, "k", "at", ["v"]).collect()} == {1: "c", 2: "d"}


def test_short_call_takes_membership_of_latest_long_call(spark):
    out = by(mart(spark, agent_calls=[
        call(1, 0), call(2, 10), call(3, 20, talk=30), call(4, 5, talk=10), call(5, -5, talk=1),
        call(6, 30, talk=None)],
        sessions=[{"call_id": i, "session_start_date": date(2024, 1, 10)} for i in (2, 4, 6)]), "call_id")
    assert {i: out[i]["membership"] for i in out} == {
        1: "control", 2: "treatment",
        3: "treatment",      # anchored to call 2
        4: "control",        # registered itself, but its anchor (call 1) is not
        5: "control",        # no earlier long call
        6: "treatment",      # unknown talk time: its own registration counts
    }


def test_tied_anchors_repeat_the_short_call(spark):
    rows = mart(spark, agent_calls=[call(1), call(2), call(3, 5, talk=10)],
                sessions=[{"call_id": 1, "session_start_date": date(2024, 1, 10)}]).filter("call_id = 3").collect()
    assert sorted(r.membership for r in rows) == ["control", "treatment"]


def test_ties_one_takes_the_smallest_id(spark):
    registered = [{"call_id": 2, "session_start_date": date(2024, 1, 10)}]
    tied = dict(agent_calls=[call(1), call(2), call(3, 1, talk=5)], sessions=registered)
    both = [r.membership for r in mart(spark, **tied).collect() if r.call_id == 3]
    one = extract.call_mart(sources(spark, **tied), replace(CFG, anchor_ties="one")).collect()
    assert sorted(both) == ["control", "treatment"] and [r.membership for r in one if r.call_id == 3] == ["control"]
    with pytest.raises(ValueError, match="ties"):
        anchor_calls(sources(spark, **tied).agent_calls, ties="some")


def test_look_back_feeds_anchors_only(spark):
    tables = dict(
        agent_calls=[call(1, -60 * 24 * 12), call(2, 0, talk=5)],
        sessions=[{"call_id": 1, "session_start_date": date(2023, 12, 29)}])
    plain = by(mart(spark, **tables), "call_id")
    back = by(extract.call_mart(sources(spark, **tables), replace(CFG, anchor_from=date(2023, 12, 25))), "call_id")
    assert set(plain) == set(back) == {2}
    assert plain[2]["membership"] == "control" and back[2]["membership"] == "treatment"


def test_anchor_never_crosses_agents_and_needs_agent_and_time(spark):
    facts = rows_of(spark, AGENT_CALLS,
                    call(1), call(2, 1, talk=5, employeeid=2), call(3, 1, talk=5, employeeid=None),
                    {**call(4, talk=5), "call_datetime_est": None}, call(5, 0, talk=5))
    assert [(r.short_call_id, r.anchor_call_id) for r in anchor_calls(facts).collect()] == [(5, 1)]


def test_repeated_lookup_rows_multiply_calls(spark):
    out = mart(spark, agent_calls=[call(1)],
               calls=[{"call_id": 1, "permalease_call_ind": 1, "remote_number_call": n} for n in ("555", "556", "557")],
               intents=[{"call_id": 1, "movingSwitchingExtracted": t} for t in ("Moving", "moving")]).collect()
    assert sorted((r.call_type, r.moverSwitcher) for r in out) == (
        [("Permalease", "mover")] * 4 + [("Site Session", "mover")] * 2)


def test_uniqueness_report(spark):
    src = sources(spark, agents=[{"employeeid": 1}, {"employeeid": 1}, {"employeeid": 2}, {"employeeid": None}])
    assert by(extract.lookup_uniqueness(src), "table_name")["agents"] == {
        "table_name": "agents", "key_count": 2, "repeated_keys": 1, "extra_rows": 1, "max_copies": 2}


def test_missing_name_drops_and_missing_center_keeps(spark):
    out = by(mart(spark, agent_calls=[
        call(1, agent_name=None, employeeid=9), call(2, agent_name=None, employeeid=1), call(3, agent_name="Boss"),
        call(4, center_location=None), call(5, center_location="Closed")],
        agents=[{"employeeid": 1, "employee_name": "Ann Lee"}]), "call_id")
    assert set(out) == {2, 4}
    assert out[2]["agent_name"] == "Ann Lee" and out[4]["center_location"] == "UNKNOWN"


def test_scope(spark):
    out = by(mart(spark, agent_calls=[
        call(1), {**call(2), "call_datetime_est": datetime(2023, 12, 31, 23, 59)}, call(3, conversion_exclude_ind=0)]), "call_id")
    assert set(out) == {1}


def test_derived_columns(spark):
    out = by(mart(
        spark,
        agent_calls=[
            call(1, credit_calls_ind=1, passed_credit_call_ind=0, credit_sold_calls_ind=1, hire_date=date(2023, 12, 11),
                 total_points=25.0, talk=90),
            call(2, credit_calls_ind=1, passed_credit_call_ind=None, credit_sold_calls_ind=1, total_points=24.9),
            call(3, credit_calls_ind=1, passed_credit_call_ind=1, credit_sold_calls_ind=1, hire_date=date(2024, 2, 1)),
            call(4, credit_calls_ind=None, passed_credit_call_ind=1, marketing_code_id=7),
        ],
        orders=[
            {"call_id": 1, "order_id": 1, "undiscounted_gcv": Decimal(100), "predicted_activation_rate": Decimal("0.5"),
             "order_date_est": T},
            {"call_id": 1, "order_id": 1, "undiscounted_gcv": Decimal(10), "predicted_activation_rate": None,
             "order_date_est": T},
            {"call_id": 2, "order_id": 2, "undiscounted_gcv": None, "predicted_activation_rate": Decimal(1),
             "product_name": "12 Month - Prepaid", "order_date_est": T},
        ],
        marketing=[{"mcid": 0, "marketing_bucket": "None given"}],
    ), "call_id")
    flags = ("credit_calls_flag", "passed_credit_call_flag", "failed_credit_call_flag",
             "passed_credit_sale_flag", "failed_credit_sale_flag")
    assert [out[1][f] for f in flags] == [1, 0, 1, 0, 1]
    assert [out[2][f] for f in flags] == [1, 0, 0, 0, 0]     # unknown outcome is no failure here
    assert [out[3][f] for f in flags] == [1, 1, 0, 1, 0]
    assert [out[4][f] for f in flags] == [0, 0, 0, 0, 0]
    assert [out[i]["tenure_bucket"] for i in (1, 2, 3)] == ["0-30 day Tenure", "Vet", "0-30 day Tenure"]
    assert [out[i]["tpsales_flag"] for i in (1, 2, 3)] == [1, 1, 0]
    assert (out[1]["orders"], out[1]["total_revenue"], out[3]["orders"]) == (1, 50, 0)
    assert [out[i]["marketing_bucket"] for i in (1, 4)] == ["None given", "Other"]
    assert (out[1]["talk_time_minutes"], out[1]["talk_time_minutes_sold"], out[1]["talk_time_minutes_unsold"]) == (1.5, 1.5, None)
    assert out[3]["talk_time_minutes_sold"] is None
    assert (out[1]["week_start"], out[1]["month_start"], out[1]["day_of_week"]) == (
        date(2024, 1, 8), date(2024, 1, 1), "Wednesday")


def test_mart_columns(spark):
    assert mart(spark).dtypes == [(f.name, f.dataType.simpleString()) for f in CALL_MART.fields]


@pytest.mark.parametrize("local, utc, kept", [
    (datetime(2024, 1, 1), None, True),
    (datetime(2023, 12, 31, 23, 59), datetime(2024, 6, 1), False),     # the local time decides
    (None, datetime(2024, 1, 1, 4, 59), False),                        # still the old year in New York
    (None, datetime(2024, 1, 1, 5, 0), True),
    (None, None, False),
])
def test_effective_order_day(spark, local, utc, kept):
    orders = rows_of(spark, ORDERS, {"call_id": 1, "order_id": 1, "order_date_est": local, "order_date_utc": utc})
    assert (orders_since(orders, date(2024, 1, 1)).count() == 1) is kept


def test_scoped_order_lines_lie_in_partitions_of_bounded_size(spark, monkeypatch):
    from dialtone.operators import order_rollup as rollup

    monkeypatch.setattr(rollup, "PARTITION_LINES", 100)
    orders = spark.range(6000).selectExpr("id % 1500 AS call_id", "id AS order_id")
    scoped = rollup.in_scope(orders, spark.range(0, 1500, 2).selectExpr("id AS call_id"))
    assert scoped.rdd.getNumPartitions() == 60
    assert sorted(map(tuple, scoped.collect())) == sorted((i % 1500, i) for i in range(6000) if i % 2 == 0)


def test_order_rollup_counts_distinct_orders(spark):
    orders = rows_of(spark, ORDERS, *[{"call_id": 1, "order_id": o} for o in (1, 1, 2, None)])
    row = order_rollup(orders).first()
    assert (row.order_count, row.order_value, row.has_prepaid) == (2, 0, 0)


def test_repeat_rows_over_several_blocks(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0), ("d", 6)], "k STRING, n INT")
    out = {r.k: r["count"] for r in repeat_rows(df, "n", block=3).groupBy("k").count().collect()}
    assert out == {"a": 7, "b": 1, "d": 6}


def test_stage_is_used_and_changes_nothing(spark):
    src = sources(spark, agent_calls=[call(1), call(2, 5, talk=3)], sessions=[
        {"call_id": 1, "session_start_date": date(2024, 1, 10)}])
    newest = extract.deduplicated_calls(extract.scoped_calls(src, CFG))
    plain, via = extract.call_mart(src, CFG), extract.call_mart(src, CFG, calls=staged(newest))
    assert sorted(plain.collect()) == sorted(via.collect())


_events = st.lists(st.tuples(
    st.integers(1, 2), st.integers(0, 12), st.sampled_from([None, 5, 30, 31, 90])), min_size=1, max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_events)
def test_anchor_equals_brute_force(spark, events):
    """Calls of two agents over two hours, in buckets of ten minutes."""
    rows = [(i, agent, T + timedelta(minutes=10 * m), talk) for i, (agent, m, talk) in enumerate(events)]
    df = spark.createDataFrame(
        rows, "call_id BIGINT, employeeid BIGINT, call_datetime_est TIMESTAMP_NTZ, talk_time_seconds INT")
    want = set()
    for i, agent, at, talk in rows:
        if talk is not None and talk <= 30:
            longs = [r for r in rows if r[1] == agent and r[3] is not None and r[3] > 30 and r[2] <= at]
            last = max((r[2] for r in longs), default=None)
            want |= {(i, r[0]) for r in longs if r[2] == last}
    got = [tuple(r) for r in anchor_calls(df, bucket_seconds=600).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_anchor_of_one_agent_with_most_calls_equals_join(spark):
    df = spark.range(4000).selectExpr(
        "id AS call_id", "if(id % 3 = 0, 1, 1 + id % 50) AS employeeid",
        "TIMESTAMP_NTZ '2024-01-01' + make_interval(0,0,0,0,0,0, id * 37 % 1000 * 60) AS call_datetime_est",
        "int(id * 7 % 61) AS talk_time_seconds")
    short = df.filter("talk_time_seconds <= 30").alias("s")
    long = df.filter("talk_time_seconds > 30").alias("l")
    joined = short.join(
        long, F.expr("s.employeeid = l.employeeid AND l.call_datetime_est <= s.call_datetime_est")
    ).groupBy("s.call_id").agg(F.max("l.call_datetime_est"))
    windowed = latest_prior_long_call(df)
    assert joined.exceptAll(windowed).count() == 0 and windowed.exceptAll(joined).count() == 0


# --- state between refreshes, classes, one-shuffle lookups -----------------------

def _anchored(spark, sf_dir, **changes):
    src = adapter.extract_sources(spark, sf_dir, fan_out=True)
    cfg = replace(adapter.EXTRACT, **changes)
    return src, cfg


def test_state_carries_anchors_over_a_seam(spark, sf_dir):
    """The second run finds what one run over all days finds, without a look at a fact before its first day."""
    seam = date(2024, 1, 16)
    for ties in ("all", "one"):
        src, cfg = _anchored(spark, sf_dir, anchor_ties=ties, related_from=adapter.EXTRACT.from_date)
        registered = extract.registered_calls(src, cfg)
        newest = extract.deduplicated_calls(extract.scoped_calls(src, cfg))
        state = extract.membership_state(newest, registered, cfg)
        whole = extract.anchor_membership(newest.select(*extract.ANCHOR_COLUMNS), registered, cfg)
        day = F.to_date("call_datetime_est")
        late = newest.filter(day >= F.lit(seam)).select(*extract.ANCHOR_COLUMNS)
        before = state.filter(F.col("day") < F.lit(seam)).groupBy("employeeid").agg(
            F.expr("max(struct(anchor_at, registered_anchors, other_anchors, smallest)) AS last")).select("employeeid", "last.*")
        carried = extract.anchor_membership(late, registered, cfg, before)
        alone = extract.anchor_membership(late, registered, cfg)
        wanted = whole.join(late.select("call_id"), "call_id", "left_semi")
        assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, wanted.collect()))
        assert carried.count() > alone.count()


def test_refresh_with_state_reads_no_older_fact(spark, sf_dir, tmp_path):
    test_folder(spark, "x")
    src, seam, path = adapter.extract_sources(spark, sf_dir), date(2024, 1, 16), str(tmp_path / "state")
    src.agent_calls.write.parquet(str(tmp_path / "calls"))
    src = replace(src, agent_calls=spark.read.parquet(str(tmp_path / "calls")))
    cfg = replace(adapter.EXTRACT, related_from=adapter.EXTRACT.from_date)
    assert anchor_state.carried_into(spark, path, seam) is None
    days = extract.membership_state(extract.deduplicated_calls(extract.scoped_calls(src, cfg)), extract.registered_calls(src, cfg), cfg)
    anchor_state.write_state(days, path, cfg.from_date)
    stored = sorted(map(repr, anchor_state.read_state(spark, path).collect()))
    anchor_state.write_state(days.filter(f"day >= DATE '{seam}'"), path, seam)  # keeps the days before the seam
    assert sorted(map(repr, anchor_state.read_state(spark, path).collect())) == stored
    carried = anchor_state.carried_into(spark, path, seam)
    plan = plan_text(extract.call_mart(src, replace(cfg, from_date=seam), carried=carried))
    scans = [s.split("ReadSchema")[0] for s in plan.split("FileScan parquet")[1:] if "talk_time_seconds" in s.split("Batched")[0]]
    assert scans and all("GreaterThanOrEqual(call_datetime_est,2024-01-16T00:00)" in s for s in scans)
    assert "PartitionFilters: [isnotnull(call_month" in plan  # of the state


def test_staged_calls_are_read_from_the_source_once(spark, sf_dir, tmp_path):
    test_folder(spark, "x")
    src = adapter.extract_sources(spark, sf_dir)
    src.agent_calls.write.parquet(str(tmp_path / "facts"))
    src = replace(src, agent_calls=spark.read.parquet(str(tmp_path / "facts")))
    newest = extract.deduplicated_calls(extract.scoped_calls(src, adapter.EXTRACT))
    assert plan_text(newest).count("FileScan parquet") == 1
    df = extract.call_mart(src, adapter.EXTRACT, calls=staged(newest, "newest"))
    assert f"{tmp_path}/facts" not in plan_text(df)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, extract.call_mart(src, adapter.EXTRACT).collect()))


def test_classes_hold_no_pairs(spark, sf_dir):
    src, cfg = _anchored(spark, sf_dir)
    newest = extract.deduplicated_calls(extract.scoped_calls(src, cfg))
    classes = anchor_classes(newest)
    pairs = sorted(map(tuple, anchor_calls(newest).collect()))
    assert sorted(map(tuple, pairs_of_classes(classes).collect())) == pairs
    rows = classes.collect()
    assert len(rows) == len({p[0] for p in pairs}) + len({p[1] for p in pairs}) < len(pairs) + len({p[1] for p in pairs})
    assert len({(r.call_id, r.is_anchor) for r in rows}) == len(rows)


def test_counted_values(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (None, "a")], "k INT, v STRING")
    counted = lookups.counted_values(table, "k", F.col("v"), ("a", "b"), "counts")
    calls = spark.createDataFrame([(1,), (2,), (3,)], "k INT")
    out = lookups.unfolded(lookups.attach(calls, counted, "k"), "counts", ("a", "b"), "v", "n")
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, "a", 2), (1, "b", 1), (2, "b", 1), (3, None, None)]
    for odd in ("c", None):
        with pytest.raises(Exception, match="not a known value"):
            lookups.counted_values(spark.createDataFrame([(1, odd)], "k INT, v STRING"), "k", F.col("v"), ("a", "b"), "counts").collect()


def test_a_lookup_of_few_values_is_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table = spark.range(100).selectExpr("id % 40 AS k", "if(id % 3 = 0, 'a', 'b') AS v")
        calls = spark.range(50).selectExpr("id AS k", "id AS x")
        once = lookups.attach(calls, lookups.counted_values(table, "k", F.col("v"), ("a", "b"), "counts"), "k")
        twice = lookups.attach(calls, lookups.counted(table, {"k": "k"}, {"v": "v"}, "n"), "k")
        assert plan_text(once).count("Exchange") == 2 and plan_text(twice).count("Exchange") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
