"""Files in and out."""

from __future__ import annotations

import csv
import os
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.session import test_folder

from dialtone.schemas import AGENTS, conform, typed
from dialtone.sources import cache, csv_files, sinks, storage, warehouse
from tests.helpers import calls, lift_facts, plan_text


def write(path, header, *rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def test_call_files_are_put_together_by_name(spark, tmp_path):
    write(tmp_path / "agent_calls_2024-01.csv", ["call_id", "call_date_est", "orders", "note"], [1, "2024-01-05", "1.0", "x"])
    write(tmp_path / "agent_calls_2024-02.csv", ["orders", "call_id", "call_date_est"], ["", 2, "2024-02-05 00:00:00"])
    write(tmp_path / "other.csv", ["call_id"], [9])
    rows = csv_files.load_call_files(spark, str(tmp_path)).orderBy("call_id").collect()
    assert [(r.call_id, r.call_date_est, r.orders, r.note) for r in rows] == [
        (1, date(2024, 1, 5), 1, "x"), (2, date(2024, 2, 5), None, None)]
    assert "talk_time_minutes" not in rows[0].asDict()      # absent stays absent


def test_no_call_files_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_files.load_call_files(spark, str(tmp_path))


def test_malformed_time_is_an_error(spark, tmp_path):
    write(tmp_path / "agent_calls_1.csv", ["call_id", "call_date_est"], [1, "soon"])
    with pytest.raises(PySparkException):
        csv_files.load_call_files(spark, str(tmp_path)).collect()


LIFT_HEADER = ["period", "week", "call_datetime_est", "call_date_fo", "gcv_revenue", "order_orders", "marketing_bucket"]


def lift_row(period, revenue, bucket="Web"):
    return [period, "01/15/2024", "2024-01-16 10:00:00.000001", "2024-01-16", revenue, "2", bucket]


def test_lift_files(spark, tmp_path):
    base = str(tmp_path / "centre")
    write(base + "_post.csv", LIFT_HEADER, lift_row("post", "12.5"), lift_row("post", "n.a.", "NA"))
    write(base + "_pre.csv", LIFT_HEADER, lift_row("pre", "nan"))
    for part in (1, 2):
        write(f"{base}_pre_weekly_{part}.csv", [*LIFT_HEADER, "post_week"], [*lift_row("pre_weekly", str(part)), "01/15/2024"])
    rows = csv_files.load_lift_files(spark, base).collect()
    assert sorted((r.period, r.gcv_revenue, r.post_week) for r in rows if r.gcv_revenue is not None) == [
        ("post", 12.5, None), ("pre_weekly", 1.0, "01/15/2024"), ("pre_weekly", 2.0, "01/15/2024")]
    assert sorted((r.period, r.marketing_bucket or "") for r in rows if r.gcv_revenue is None) == [("post", ""), ("pre", "Web")]
    assert rows[0].call_datetime_est == datetime(2024, 1, 16, 10, 0, 0, 1)


@pytest.mark.parametrize("lacking", ["_post.csv", "_pre.csv", "_pre_weekly_1.csv"])
def test_each_kind_of_lift_file_is_required(spark, tmp_path, lacking):
    base = str(tmp_path / "centre")
    for suffix in ("_post.csv", "_pre.csv", "_pre_weekly_1.csv"):
        if suffix != lacking:
            write(base + suffix, LIFT_HEADER, lift_row("post", "1"))
    with pytest.raises(FileNotFoundError):
        csv_files.load_lift_files(spark, base)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_writing_a_mart_replaces_its_months_only(spark, tmp_path, fmt):
    path = str(tmp_path / "mart")

    def days(*d):
        return calls(spark, *[dict(call_date_est=x, talk_time_minutes=1.0) for x in d])

    jan, feb = date(2024, 1, 5), date(2024, 2, 5)
    sinks.write_call_mart(days(jan, jan, feb, None), path, fmt)
    sinks.write_call_mart(days(jan), path, fmt)
    back = sinks.read_call_mart(spark, path, fmt, schema=days(jan).schema)
    assert [tuple(r) for r in sinks.month_counts(back).collect()] == [("2024-01", 1), ("2024-02", 1)]
    assert [tuple(r) for r in sinks.month_counts(days(jan, jan, feb, None)).collect()] == [("2024-01", 2), ("2024-02", 1)]


def test_date_range_prunes_months(spark, tmp_path):
    from dialtone.operators.filters import between_days
    from dialtone.plans.overview import compare_periods
    path = str(tmp_path / "mart")
    mart = calls(spark, *[dict(call_date_est=date(2024, m, 5)) for m in (1, 2, 3)])
    sinks.write_call_mart(mart, path)
    back = sinks.read_call_mart(spark, path, schema=mart.schema)
    plan = plan_text(between_days(back, "call_date_est", date(2024, 2, 1), date(2024, 2, 20)))
    assert "PartitionFilters: [isnotnull(call_month" in plan and "PushedFilters: [IsNotNull(call_date_est)" in plan
    assert between_days(back, "call_date_est", date(2024, 2, 20), date(2024, 2, 1)).count() == 0
    compared = compare_periods(back, (date(2024, 1, 1), date(2024, 1, 9)), (date(2024, 2, 9), date(2024, 2, 1)))
    assert compared.first().first_value == 1 and compared.first().second_value == 1
    assert "(call_month" in plan_text(compared).split("PartitionFilters")[1]


@pytest.mark.parametrize("fmt, sep", [("csv", ","), ("tsv", "\t")])
def test_report_export(spark, tmp_path, fmt, sep):
    path = tmp_path / "report"
    df = spark.createDataFrame([("a, \"b\"", 1), ("c", 2)], "name STRING, n INT").orderBy("n")
    sinks.export_report(df, str(path), fmt, single_file=True)
    (file,) = path.glob("part-*.csv")
    with open(file, newline="") as f:
        assert list(csv.reader(f, delimiter=sep)) == [["name", "n"], ["a, \"b\"", "1"], ["c", "2"]]


def test_cached_load_expires(spark):
    now, loads = [0.0], []

    def load():
        loads.append(1)
        return spark.range(3)

    kept = cache.CachedLoad(load, ttl_seconds=10, clock=lambda: now[0])
    first = kept.get()
    now[0] = 9.9
    assert kept.get() is first and first.is_cached
    now[0] = 10
    assert kept.get() is not first and len(loads) == 2
    forever = cache.CachedLoad(load, ttl_seconds=None, clock=lambda: now[0])
    forever.get()
    now[0] = 1e9
    forever.get()
    assert len(loads) == 3
    kept.clear(), forever.clear()


def test_shared_folder_is_the_configured_one(spark):
    test_folder(spark, "x")  # names a shared folder if the session has none
    assert storage.shared_folder(spark) == storage.named_folder(spark).rstrip("/")
    assert storage.new_folder(spark, "x") != storage.new_folder(spark, "x")
    assert sorted(r.id for r in storage.staged(spark.range(3)).collect()) == [0, 1, 2]


def test_shared_folder_without_a_name(spark, monkeypatch):
    monkeypatch.setattr(storage, "named_folder", lambda _: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.staged(spark.range(2))


def test_sources_have_their_declared_columns(spark, tmp_path):
    for role, schema in warehouse.SCHEMAS.items():
        spark.createDataFrame([], schema).selectExpr("*", "'x' AS extra").write.parquet(str(tmp_path / role))
    spark.sql("SELECT 7 AS employeeid, 'Ann' AS employee_name, 1 AS other").createOrReplaceTempView("agents_table")
    locations = {role: str(tmp_path / role) for role in warehouse.SCHEMAS}
    src = warehouse.load_sources(spark, {**locations, "agents": "agents_table"})
    assert src.agents.columns == AGENTS.names and src.agents.first().employee_name == "Ann"
    assert src.orders.columns == warehouse.SCHEMAS["orders"].names
    with pytest.raises(ValueError, match="agents"):
        warehouse.load_sources(spark, {r: p for r, p in locations.items() if r != "agents"})


def test_absent_column_is_an_error(spark, tmp_path):
    for role, schema in warehouse.SCHEMAS.items():
        df = spark.createDataFrame([], schema)
        (df.drop("conversion_exclude_ind") if role == "agent_calls" else df).write.parquet(str(tmp_path / role))
    with pytest.raises(ValueError, match="agent_calls lacks: conversion_exclude_ind"):
        warehouse.load_sources(spark, {role: str(tmp_path / role) for role in warehouse.SCHEMAS})


@pytest.mark.parametrize("row, problem", [
    ("1,2024-01-05,a,b", "MALFORMED"), ("1.5,2024-01-05,a", "not a whole number: 1.5"), ("oops,2024-01-05,a", "not a whole number: oops")])
def test_call_files_lose_nothing_silently(spark, tmp_path, row, problem):
    (tmp_path / "agent_calls_1.csv").write_text(f"orders,call_date_est,agent_name\n{row}\n")
    with pytest.raises(Exception) as failed:
        csv_files.load_call_files(spark, str(tmp_path)).collect()
    assert problem in str(failed.value)


def test_call_files_with_texts_of_several_lines(spark, tmp_path):
    (tmp_path / "agent_calls_1.csv").write_text('orders,call_date_est,agent_name\n2.0,2024-01-05,"Ann ""A"",\nBee"\n,2024-01-06,C\n')
    rows = csv_files.load_call_files(spark, str(tmp_path)).orderBy("call_date_est").collect()
    assert [(r.orders, r.agent_name) for r in rows] == [(2, 'Ann "A",\nBee'), (None, "C")]


def test_listing_brings_one_row_per_entry(spark, tmp_path):
    for name in ("agent_calls_1.csv", "agent_calls_2.csv"):
        spark.range(20).repartition(5).write.option("header", True).csv(str(tmp_path / name))
    found = csv_files.list_files(spark, f"{tmp_path}/agent_calls_*.csv")
    assert [f.rsplit("/", 1)[1] for f in found] == ["agent_calls_1.csv", "agent_calls_2.csv"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_refresh_from_the_middle_of_a_month_keeps_its_start(spark, tmp_path, fmt):
    test_folder(spark, "x")
    path, days = str(tmp_path / "mart"), (3, 10, 20)
    mart = calls(spark, *[dict(call_date_est=date(2024, 1, d), agent_name=f'A "{d}",\nB') for d in days])
    sinks.write_call_mart(mart, path, fmt)
    later = calls(spark, dict(call_date_est=date(2024, 1, 15)), dict(call_date_est=date(2024, 2, 1)))
    sinks.write_call_mart(later, path, fmt, since=date(2024, 1, 12))
    rows = sinks.read_call_mart(spark, path, fmt, schema=mart.schema).collect()
    assert sorted((r.call_date_est.month, r.call_date_est.day, r.agent_name) for r in rows) == [
        (1, 3, 'A "3",\nB'), (1, 10, 'A "10",\nB'), (1, 15, "Ann"), (2, 1, "Ann")]


def test_one_file_is_for_small_reports(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SINGLE_FILE_ROWS", 10)
    with pytest.raises(ValueError):
        sinks.export_report(spark.range(11), str(tmp_path / "r"), single_file=True)


def test_default_window_reads_the_last_months_only(spark, tmp_path):
    from dialtone.operators.filters import in_default_window
    path = str(tmp_path / "mart")
    mart = calls(spark, *[dict(call_date_est=d) for d in (date(2024, 1, 5), date(2024, 2, 26), date(2024, 3, 1), date(2024, 3, 3))])
    sinks.write_call_mart(mart, path)
    recent = in_default_window(sinks.read_call_mart(spark, path, schema=mart.schema))
    assert sorted(r.call_date_est for r in recent.collect()) == [date(2024, 2, 26), date(2024, 3, 1), date(2024, 3, 3)]
    assert "(call_month" in plan_text(recent).split("PartitionFilters")[1]


def test_rollup_is_kept_by_month(spark, tmp_path):
    from dialtone.jobs import refresh_rollup
    from dialtone.operators.filters import between_days
    mart = calls(spark, *[dict(call_date_est=date(2024, m, 5)) for m in (1, 2, 3)])
    sinks.write_call_mart(mart, str(tmp_path / "mart"))
    rollup = refresh_rollup(spark, str(tmp_path / "mart"), str(tmp_path / "daily"), schema=mart.schema)
    plan = plan_text(between_days(rollup, "call_date_est", date(2024, 2, 1), date(2024, 2, 20)))
    assert "PartitionFilters: [isnotnull(call_month" in plan
    again = refresh_rollup(spark, str(tmp_path / "mart"), str(tmp_path / "daily"), date(2024, 3, 1), schema=mart.schema)
    assert again.count() == 3


def test_conform_and_typed(spark):
    df = spark.createDataFrame([("7", "None", "u")], "employeeid STRING, employee_name STRING, extra STRING")
    assert typed(df, AGENTS).first() == (7, None, "u")
    assert conform(df, AGENTS).dtypes == [("employeeid", "bigint"), ("employee_name", "string")]
    with pytest.raises(ValueError, match="employee_name"):
        conform(df.select("employeeid"), AGENTS)


def stored_ids(spark, path, mart):
    rows = sinks.read_call_mart(spark, path, schema=mart.schema).collect()
    return sorted(((r.call_id, r.call_date_est.month, r.call_date_est.day) for r in rows), key=repr)


def numbered(spark, *rows):
    return spark.createDataFrame(
        [(i, d, f"c{(i or 0) % 2}", "treatment") for i, d in rows], "call_id BIGINT, call_date_est DATE, center_location STRING, membership STRING")


def files_of(path):
    return {str(f.relative_to(path)) for f in path.glob("call_month=*/part-*")}


def test_refresh_takes_moved_calls_out_of_earlier_months(spark, tmp_path):
    test_folder(spark, "x")
    path = tmp_path / "mart"
    mart = numbered(spark, (1, date(2024, 1, 5)), (2, date(2024, 1, 9)), (3, date(2024, 2, 5)), (4, date(2024, 3, 3)), (5, date(2024, 3, 9)),
                    (6, date(2023, 12, 1)), (None, date(2024, 1, 6)))
    sinks.write_call_mart(mart, str(path))
    before = files_of(path)
    # call 2 of January, 4 of this month's start and 6, the only one of December, are seen again from March 8 on; 2 is in the mart no more
    later = numbered(spark, (4, date(2024, 3, 8)), (6, date(2024, 4, 1)))
    seen = numbered(spark, (2, date(2024, 3, 9)), (4, date(2024, 3, 8)), (6, date(2024, 4, 1)))
    held = sinks.write_call_mart(later, str(path), since=date(2024, 3, 8), replaced=seen)
    assert held == ["2023-12", "2024-01"]
    assert stored_ids(spark, str(path), mart) == [(1, 1, 5), (3, 2, 5), (4, 3, 8), (6, 4, 1), (None, 1, 6)]
    # the files of an untouched month are the same ones, those of December are gone
    untouched = {f for f in before if "2024-02" in f}
    assert untouched and untouched <= files_of(path) and not any("2023-12" in f for f in files_of(path))
    shared = storage.shared_folder(spark)
    assert not [f for f in os.listdir(shared) if f.startswith(("kept-days", "replaced-calls"))]


def test_refresh_that_empties_the_start_of_its_month(spark, tmp_path):
    test_folder(spark, "x")
    path = str(tmp_path / "mart")
    mart = numbered(spark, (1, date(2024, 1, 5)), (2, date(2024, 2, 9)))
    sinks.write_call_mart(mart, path)
    later = numbered(spark, (1, date(2024, 2, 1)))
    sinks.write_call_mart(later, path, since=date(2024, 1, 20), replaced=later)
    assert stored_ids(spark, path, mart) == [(1, 2, 1)]


def test_first_refresh_finds_nothing_to_replace(spark, tmp_path):
    test_folder(spark, "x")
    mart = numbered(spark, (1, date(2024, 1, 5)))
    assert sinks.write_call_mart(mart, str(tmp_path / "mart"), since=date(2024, 1, 1), replaced=mart) == []


def test_noted_days(spark, tmp_path):
    test_folder(spark, "x")
    from dialtone.operators.filters import noted_bounds
    path = str(tmp_path / "mart")
    mart = numbered(spark, (1, date(2024, 1, 5)), (2, date(2024, 1, 9)), (3, date(2024, 2, 5))).unionByName(
        numbered(spark, (9, date(2024, 2, 20))).withColumn("membership", F.lit("control")))
    sinks.write_call_mart(mart, path)
    sinks.note_days(spark, path, schema=mart.schema)
    noted = {(r.call_month, r.membership): (r.first_day.day, r.last_day.day, r.saved_rows) for r in sinks.read_days(spark, path).collect()}
    assert noted == {("2024-01", "treatment"): (5, 9, 2), ("2024-02", "treatment"): (5, 5, 1), ("2024-02", "control"): (20, 20, 1)}
    assert tuple(noted_bounds(sinks.read_days(spark, path)).first()) == (date(2024, 1, 5), date(2024, 2, 5))
    # a later run notes its own months only
    sinks.write_call_mart(numbered(spark, (3, date(2024, 2, 7))), path, since=date(2024, 2, 1))
    sinks.note_days(spark, path, schema=mart.schema, since=date(2024, 2, 1))
    assert {(r.call_month, r.last_day.day) for r in sinks.read_days(spark, path).collect()} == {("2024-01", 9), ("2024-02", 7)}


def test_default_window_with_noted_days_reads_no_other_month(spark, tmp_path):
    test_folder(spark, "x")
    from dialtone.operators.filters import default_comparison, in_default_window, noted_bounds
    from dialtone.plans.overview import compare_periods
    path = str(tmp_path / "mart")
    days = (date(2024, 1, 5), date(2024, 2, 20), date(2024, 2, 26), date(2024, 3, 1), date(2024, 3, 3))
    mart = calls(spark, *[dict(call_date_est=d) for d in days])
    sinks.write_call_mart(mart, path)
    sinks.note_days(spark, path, schema=mart.schema)
    bounds = noted_bounds(sinks.read_days(spark, path))
    chosen = sinks.read_call_mart(spark, path, schema=mart.schema).filter("center_location = 'North' AND ib_contact_calls = 0")
    recent = in_default_window(chosen, bounds=bounds)
    assert sorted(r.call_date_est for r in recent.collect()) == [date(2024, 2, 26), date(2024, 3, 1), date(2024, 3, 3)]
    w = default_comparison(chosen, bounds=bounds)
    compared = compare_periods(chosen, *[[w.select(c).scalar() for c in pair] for pair in (("p1_start", "p1_end"), ("p2_start", "p2_end"))])
    assert compared.first().first_value == 1 and compared.first().second_value == 3
    for df in (recent, compared):
        scans = [line for line in plan_text(df).split("FileScan parquet")[1:] if "center_location" in line.split("ReadSchema")[0]]
        assert scans and all("(call_month" in s.split("PartitionFilters")[1].split("PushedFilters")[0] for s in scans)


def test_days_of_a_month_are_clustered(spark, tmp_path):
    """A one-day filter has to read few row groups of a month."""
    import pyarrow.parquet as pq
    path = tmp_path / "mart"
    mart = spark.range(60_000).selectExpr(
        "id AS call_id", "date_add(DATE '2024-01-01', int(id * 7919 % 31)) AS call_date_est", "concat('c', id % 9) AS center_location",
        "sha2(string(id), 256) AS pc")
    spark.conf.set("parquet.block.size", 128 * 1024)
    try:
        sinks.write_call_mart(mart.repartition(6), str(path))
    finally:
        spark.conf.unset("parquet.block.size")
    day, groups, wanted = date(2024, 1, 12), 0, 0
    for file in path.glob("call_month=2024-01/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("call_date_est")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            groups += 1
            wanted += stats.min <= day <= stats.max
    assert groups >= 10 and wanted <= groups / 4


def test_report_in_one_file_is_made_once(spark, tmp_path):
    test_folder(spark, "x")
    made = spark.sparkContext.accumulator(0)
    rows = spark.range(4).repartition(2)
    rows = rows.mapInPandas(lambda parts: (made.add(len(p)) or p for p in parts), "id BIGINT")
    sinks.export_report(rows, str(tmp_path / "r"), single_file=True)
    assert made.value == 4


def test_lift_table_prunes_baselines(spark, tmp_path):
    from dialtone.config import LiftWindow
    from dialtone.plans import lift
    from dialtone.sources import lift_table
    weeks = ("01/15/2024", "01/22/2024", "01/29/2024")
    rows = [dict(period="post", week=w, call_datetime_est=datetime(2024, 1, 16 + 7 * i, 9), cohort=c) for i, w in enumerate(weeks) for c in ("treatment", "control")]
    rows += [dict(period="pre_weekly", week="01/01/2024", post_week=w, call_datetime_est=datetime(2024, 1, 3, 9), cohort=c) for w in weeks for c in ("treatment", "control")]
    rows += [dict(period="pre", week="01/01/2024", call_datetime_est=datetime(2024, 1, 3, 9), canonical_cohort="control")]
    facts = lift_facts(spark, *rows)
    path = str(tmp_path / "lift")
    lift_table.write_lift_facts(facts, path)
    back = lift_table.read_lift_facts(spark, path, facts.schema)
    assert sorted(map(repr, back.select(*facts.columns).collect())) == sorted(map(repr, facts.collect()))
    window = LiftWindow(date(2024, 1, 1), date(2024, 1, 10), date(2024, 1, 20), date(2024, 1, 26))
    plain, table = (lift.weekly_lift(lift.weekly_scope(f, window)) for f in (facts, back))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, plain.collect())) and {r.week for r in table.collect()} == {weeks[1]}
    assert "dynamicpruning" in plan_text(table).split("PartitionFilters")[1]
    # a week that is written again replaces itself alone
    again = facts.filter(f"post_week = '{weeks[0]}' OR week = '{weeks[0]}'")
    lift_table.write_lift_facts(again, path)
    assert lift_table.read_lift_facts(spark, path, facts.schema).count() == len(rows)
    assert lift.fixed_baseline(back, window).count() == 1


def test_lift_files_into_a_table(spark, tmp_path):
    from dialtone.jobs import load_lift_table
    head = "period,week,post_week,cohort,canonical_cohort,call_datetime_est,gcv_revenue"
    (tmp_path / "c_post.csv").write_text(f"{head}\npost,01/15/2024,,treatment,,2024-01-16 09:00:00,5\n")
    (tmp_path / "c_pre.csv").write_text(f"{head}\npre,01/01/2024,,,control,2024-01-02 09:00:00,x\n")
    (tmp_path / "c_pre_weekly_1.csv").write_text(f"{head}\npre_weekly,01/01/2024,01/15/2024,control,,2024-01-02 09:00:00,7\n")
    rows = load_lift_table(spark, f"{tmp_path}/c", f"{tmp_path}/table").collect()
    assert sorted((r.period, r.week_key or "", r.gcv_revenue) for r in rows if r.gcv_revenue) == [("post", "01/15/2024", 5.0), ("pre_weekly", "01/15/2024", 7.0)]
    assert [(r.period, r.week_key, r.gcv_revenue) for r in rows if r.period == "pre"] == [("pre", None, None)]
