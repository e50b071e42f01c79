"""One Spark query per operator of the inventory, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks import adapter
from checks.session import test_folder
from dialtone.config import CallFilters, LiftWindow
from dialtone.functions import periods, scopes
from dialtone.jobs import refresh_call_mart, refresh_rollup
from dialtone.operators import filters, metrics as m
from dialtone.operators.anchor import anchor_calls, anchor_classes, latest_prior_long_call, pairs_of_classes
from dialtone.operators.dedup import latest_version
from dialtone.operators.lookups import member_flag
from dialtone.operators.measures import daily_rollup
from dialtone.operators.order_rollup import in_scope, order_rollup, orders_since
from dialtone.plans import agents, extract, lift, overview
from dialtone.sources import csv_files, lift_table, sinks
from dialtone.sources.cache import CachedLoad
from dialtone.sources.warehouse import SCHEMAS

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Column suffix of each filterable dimension in query names.
DIMENSIONS = {
    "center": "center_location", "marketing": "marketing_bucket", "mover": "moverSwitcher",
    "tenure": "tenure_bucket", "call_type": "call_type",
}
LIFT_DIMENSIONS = {
    "marketing": "marketing_bucket", "mover": "mover_switcher",
    "tenure": "tenure_bucket", "call_type": "call_type",
}
SELECTED = CallFilters(
    start=date(2024, 1, 5), end=date(2024, 1, 20),
    center_location=("ASIA", "EUROPE", "AFRICA"), marketing_bucket=("1-URGENT", "2-HIGH", "5-LOW"),
    mover_switcher=("mover", "switcher"), tenure_bucket=("Vet", "31-60 day Tenure", "61-90 day Tenure"),
    call_type=("Site Session",),
)
WINDOW = LiftWindow(
    pre_start=date(2024, 1, 3), pre_end=date(2024, 1, 12),
    post_from=date(2024, 1, 17), post_to=date(2024, 1, 28),
)


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        _QUERIES[name] = run
        return run
    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    # Scaled, rounded and scaled back, as SQL engines on binary doubles do; the
    # small shift keeps sums that differ in their last bit off a rounding edge.
    scale = f"1{'0' * places}D"
    return df.selectExpr(*[
        f"round((CAST(`{c}` AS DOUBLE) + 1e-9D) * {scale}) / {scale} AS `{c}`" if c in columns else f"`{c}`"
        for c in df.columns])


def _treated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.treatment_only(adapter.calls(spark, sf_dir))


# --- extract -----------------------------------------------------------------

@query("dedup_latest_version")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = adapter.table(spark, sf_dir, "lineitem")
    others = [c for c in lines.columns if c not in ("l_orderkey", "l_shipdate")]
    return latest_version(lines, "l_orderkey", "l_shipdate", others)


@query("scope_lower_bound")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = adapter.extract_sources(spark, sf_dir)
    recent = filters.since(src.agent_calls, "call_datetime_est", date(2024, 1, 12))
    return filters.not_excluded(recent, "conversion_exclude_ind").select(
        "call_id", "call_datetime_est", "employeeid", F.col("talk_time_seconds").cast("double").alias("talk_seconds"))


def _newest(spark: SparkSession, sf_dir: str, fan_out: bool = False) -> DataFrame:
    src = adapter.extract_sources(spark, sf_dir, fan_out)
    return extract.deduplicated_calls(extract.scoped_calls(src, adapter.EXTRACT))


@query("anchor_times")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_prior_long_call(_newest(spark, sf_dir))


@query("anchor_calls")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_calls(_newest(spark, sf_dir))


@query("anchor_calls_tied")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_calls(_newest(spark, sf_dir, fan_out=True))


@query("anchor_calls_one")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_calls(_newest(spark, sf_dir, fan_out=True), ties="one")


@query("anchor_classes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_classes(_newest(spark, sf_dir, fan_out=True))


@query("anchor_classes_unfolded")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of_classes(anchor_classes(_newest(spark, sf_dir, fan_out=True)))


@query("registry_membership")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = adapter.extract_sources(spark, sf_dir)
    calls = adapter.table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"))
    registered = extract.registered_calls(src, adapter.EXTRACT)
    return member_flag(calls, registered, "call_id", "registered").withColumn(
        "registered", F.col("registered").cast("int"))


@query("order_rollup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = adapter.extract_sources(spark, sf_dir)
    calls = extract.scoped_calls(src, adapter.EXTRACT)
    scoped = in_scope(orders_since(src.orders, adapter.EXTRACT.from_date), calls)
    return _rounded(order_rollup(scoped), "order_value", places=4)


@query("lookup_uniqueness")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lookup_uniqueness(adapter.extract_sources(spark, sf_dir, fan_out=True))


def _mart(spark: SparkSession, sf_dir: str, fan_out: bool = False) -> DataFrame:
    return extract.call_mart(adapter.extract_sources(spark, sf_dir, fan_out), adapter.EXTRACT)


@query("call_mart")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(_mart(spark, sf_dir))


def _comparable(mart: DataFrame) -> DataFrame:
    mart = _rounded(mart, "gcv_fo", "total_revenue", places=4)
    return _rounded(mart, "talk_time_minutes", "talk_time_minutes_sold", "talk_time_minutes_unsold")


@query("call_mart_newest_first")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(extract.newest_first(_mart(spark, sf_dir)))


@query("mart_from_tables")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scheduler runs: written source tables, the refresh job, the written mart."""
    folder, src = test_folder(spark, "tables"), adapter.extract_sources(spark, sf_dir)
    for role in SCHEMAS:
        getattr(src, role).write.parquet(f"{folder}/{role}")
    refresh_call_mart(spark, {role: f"{folder}/{role}" for role in SCHEMAS}, adapter.EXTRACT, f"{folder}/mart")
    return _comparable(sinks.read_call_mart(spark, f"{folder}/mart").drop(sinks.MONTH))


@query("mart_over_a_seam")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refreshes: all days before the seam, then those from it on, with the anchors that the first one kept."""
    folder, src, seam = test_folder(spark, "seam"), adapter.extract_sources(spark, sf_dir), date(2024, 1, 16)
    for role in SCHEMAS:
        getattr(src, role).write.parquet(f"{folder}/{role}")
    early = src.agent_calls.filter(F.col("call_datetime_est") < F.lit(seam).cast("timestamp_ntz"))
    early.write.parquet(f"{folder}/early_calls")
    tables = {role: f"{folder}/{role}" for role in SCHEMAS}
    refresh_call_mart(
        spark, {**tables, "agent_calls": f"{folder}/early_calls"}, adapter.EXTRACT, f"{folder}/mart", state_path=f"{folder}/state")
    later = replace(adapter.EXTRACT, from_date=seam, related_from=adapter.EXTRACT.from_date)
    refresh_call_mart(spark, tables, later, f"{folder}/mart", stage=True, state_path=f"{folder}/state")
    return _comparable(sinks.read_call_mart(spark, f"{folder}/mart").drop(sinks.MONTH))


@query("call_mart_one")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = replace(adapter.EXTRACT, anchor_ties="one")
    mart = extract.call_mart(adapter.extract_sources(spark, sf_dir, True), one)
    return mart.groupBy("call_id", "membership", "call_type", "moverSwitcher").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("orders").alias("orders_sum"))


@query("call_mart_fan_out")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mart(spark, sf_dir, fan_out=True).groupBy(
        "call_id", "membership", "call_type", "moverSwitcher").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("orders").alias("orders_sum"))


@query("call_mart_months")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.month_counts(_mart(spark, sf_dir))


def _order_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of many months: an order per call, dated by its order date."""
    return adapter.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.to_date("o_orderdate").alias("call_date_est"),
        F.expr("""concat(o_orderpriority, chr(10), '"', o_orderstatus, '", ok')""").alias("marketing_bucket"),
        F.col("o_totalprice").cast("decimal(28,4)").alias("total_revenue"),
        F.when(F.col("o_orderstatus") != "P", F.lit(1)).alias("ib_contact_calls"))


def _month_totals(mart: DataFrame) -> DataFrame:
    return _rounded(
        mart.groupBy(F.expr(periods.month_key("call_date_est") + " AS call_month"), "marketing_bucket").agg(
            F.count(F.lit(1)).alias("saved_rows"), F.sum("total_revenue").alias("revenue"),
            F.sum("ib_contact_calls").alias("contacts")), "revenue", places=2)


@query("month_files_parquet")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, mart = test_folder(spark, "mart"), _order_mart(spark, sf_dir)
    sinks.write_call_mart(mart, path)
    return _month_totals(sinks.read_call_mart(spark, path, schema=mart.schema))


@query("month_refresh_midmonth")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, mart = test_folder(spark, "mart"), _order_mart(spark, sf_dir)
    seam = date(1997, 6, 17)
    sinks.write_call_mart(mart.filter(F.col("call_date_est") < F.lit(date(1997, 8, 1))), path)
    sinks.write_call_mart(mart.filter(F.col("call_date_est") >= F.lit(seam)), path, since=seam)
    return _month_totals(sinks.read_call_mart(spark, path, schema=mart.schema))


@query("month_refresh_moved_calls")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the first run dated earlier, in the seam's month or one before it, are there once afterwards."""
    path, mart = test_folder(spark, "mart"), _order_mart(spark, sf_dir)
    seam, day = date(1997, 6, 17), F.col("call_date_est")
    moved = F.when(day >= F.lit(seam), F.expr("CASE call_id % 3 WHEN 0 THEN 40 WHEN 1 THEN 3 ELSE 0 END")).otherwise(0)
    first = mart.withColumn("call_date_est", F.date_sub(day, moved))
    sinks.write_call_mart(first.filter(day < F.lit(date(1997, 8, 1))), path)
    later = mart.filter(day >= F.lit(seam))
    sinks.write_call_mart(later, path, since=seam, replaced=later)
    return _month_totals(sinks.read_call_mart(spark, path, schema=mart.schema))


@query("default_window_of_mart")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default window of a filtered mart, from the notes on its days."""
    path = test_folder(spark, "mart")
    mart = _order_mart(spark, sf_dir).withColumn("membership", F.expr("if(call_id % 5 < 2, 'treatment', 'control')"))
    sinks.write_call_mart(mart, path)
    sinks.note_days(spark, path, schema=mart.schema)
    calls = filters.treatment_only(sinks.read_call_mart(spark, path, schema=mart.schema)).filter("ib_contact_calls = 1")
    recent = filters.in_default_window(calls, bounds=filters.noted_bounds(sinks.read_days(spark, path)))
    return recent.groupBy("call_date_est").agg(F.count(F.lit(1)).alias("calls_seen"))


@query("month_files_csv")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, mart = test_folder(spark, "mart-csv"), _order_mart(spark, sf_dir)
    sinks.write_call_mart(mart, path, "csv")
    return _month_totals(sinks.read_call_mart(spark, path, "csv", schema=mart.schema))


@query("call_files_by_name")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, mart = test_folder(spark, "calls"), _order_mart(spark, sf_dir)
    early = F.col("call_date_est") < F.lit(date(1998, 1, 1))
    # the later file has its columns in another order and lacks one
    sinks.export_report(mart.filter(early), f"{folder}/agent_calls_1.csv")
    sinks.export_report(
        mart.filter(~early).select("total_revenue", "call_date_est", "marketing_bucket", "call_id"),
        f"{folder}/agent_calls_2.csv")
    return _month_totals(csv_files.load_call_files(spark, folder))


@query("report_export_tsv")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = test_folder(spark, "report")
    report = overview.funnel_long(_treated(spark, sf_dir), "Weekly").select("period", "metric", "kind", "value")
    sinks.export_report(report, path, "tsv", single_file=True)
    back = spark.read.option("header", True).option("sep", "\t").schema(report.schema).csv(path)
    return _rounded(back, "value")


# --- populations -------------------------------------------------------------

@query("filter_options")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_options(adapter.calls(spark, sf_dir))


@query("filtered_population")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_call_filters(adapter.calls(spark, sf_dir), SELECTED).select(
        "call_id", "call_date_est", "center_location", "marketing_bucket", "moverSwitcher",
        "tenure_bucket", "call_type")


@query("day_bounds")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.day_bounds(adapter.calls(spark, sf_dir))


@query("default_windows")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = adapter.calls(spark, sf_dir)
    one, two = filters.default_window(calls), filters.default_comparison(calls)
    return one.unpivot([], ["window_start", "window_end"], "bound", "day").unionByName(
        two.unpivot([], ["p1_start", "p1_end", "p2_start", "p2_end"], "bound", "day"))


@query("default_window_calls")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = filters.in_default_window(_treated(spark, sf_dir))
    return recent.groupBy("call_date_est").agg(F.count(F.lit(1)).alias("calls_seen"))


@query("row_scopes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = adapter.calls(spark, sf_dir)
    return calls.groupBy("call_direction").agg(
        F.expr(f"count_if({scopes.top_funnel(calls.columns)}) AS top_funnel_calls"),
        F.expr(f"count_if({scopes.order_revenue(calls.columns)}) AS order_revenue_calls"))


@query("period_buckets")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = {g: periods.period_start("o_orderdate", g) for g in periods.GRANULARITIES}
    return adapter.table(spark, sf_dir, "orders").selectExpr(
        start["Daily"] + " AS day_start", start["Weekly"] + " AS week_begin", start["Monthly"] + " AS month_begin",
        periods.period_label(start["Weekly"], "Weekly") + " AS week_label",
        periods.period_label(start["Monthly"], "Monthly") + " AS month_label",
        periods.weekday_name("o_orderdate") + " AS weekday",
    ).groupBy("day_start", "week_begin", "month_begin", "week_label", "month_label", "weekday").agg(
        F.expr("count(*) AS order_rows"))


# --- overview ----------------------------------------------------------------

@query("kpi_totals")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(overview.kpi_totals(_treated(spark, sf_dir)), *m.TOTALS)


def _funnel(granularity: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = overview.funnel_long(_treated(spark, sf_dir), granularity)
        return _rounded(report, "value").drop("shown", "kind")
    return run


for _granularity in ("Daily", "Weekly", "Monthly"):
    query("funnel_" + _granularity.lower())(_funnel(_granularity))


@query("funnel_filtered")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = filters.apply_call_filters(adapter.calls(spark, sf_dir), SELECTED)
    return _rounded(overview.funnel(some, "Weekly"), *m.FUNNEL)


@query("funnel_table_weekly")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = [date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 15), date(2024, 1, 22), date(2024, 1, 29)]
    report = overview.funnel_table(_treated(spark, sf_dir), "Weekly", weeks)
    return _rounded(report, *[w.isoformat() for w in weeks])


@query("funnel_table_discovered")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    test_folder(spark, "funnel")  # names a shared folder if the session has none
    report = overview.funnel_table(_treated(spark, sf_dir), "Weekly")
    return _rounded(report, *[c for c in report.columns if c not in ("position", "metric")])


@query("funnel_shown_weekly")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.funnel_long(_treated(spark, sf_dir), "Weekly").select("period", "metric", "kind", "label", "shown")


@query("funnel_from_written_rollup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, calls = test_folder(spark, "mart"), adapter.calls(spark, sf_dir)
    sinks.write_call_mart(calls, path)
    rollup = refresh_rollup(spark, path, f"{path}-daily", schema=calls.schema)
    some = filters.apply_call_filters(rollup, CallFilters(start=date(2024, 1, 8), end=date(2024, 1, 21)))
    return _rounded(overview.funnel(some, "Weekly"), *m.FUNNEL)


@query("cached_funnel")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = CachedLoad(lambda: _treated(spark, sf_dir), ttl_seconds=3600)
    report = overview.funnel_long(loads.get(), "Weekly")
    return _rounded(report, "value").drop("shown", "kind")


@query("funnel_from_rollup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = daily_rollup(adapter.calls(spark, sf_dir))
    report = overview.funnel_long(filters.treatment_only(rollup), "Weekly")
    return _rounded(report, "value").drop("shown", "kind")


@query("funnel_from_extract")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = overview.funnel_long(filters.treatment_only(_mart(spark, sf_dir)), "Monthly")
    return _rounded(report, "value").drop("shown", "kind", "label")


@query("week_cards")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(overview.week_cards(_treated(spark, sf_dir)), "value", "prior_value", "change_pct").drop("kind")


@query("week_cards_selected")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = overview.week_cards(filters.undated_calls(adapter.calls(spark, sf_dir), SELECTED))
    return _rounded(cards, "value", "prior_value", "change_pct").drop("kind")


@query("week_cards_shown")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.show_week_cards(overview.week_cards(_treated(spark, sf_dir)))


@query("period_comparison")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # overlapping periods, the second one with its ends swapped
    compared = overview.compare_periods(
        _treated(spark, sf_dir), (date(2024, 1, 4), date(2024, 1, 15)), (date(2024, 1, 24), date(2024, 1, 12)))
    return _rounded(compared, "first_value", "second_value", "change_pct").drop("kind")


@query("period_comparison_incomplete")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = overview.compare_periods(_treated(spark, sf_dir), (date(2024, 1, 4),), (date(2024, 1, 12), date(2024, 1, 24)))
    return _rounded(compared, "first_value", "second_value", "change_pct").drop("kind")


@query("period_comparison_default")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _treated(spark, sf_dir)
    w = filters.default_comparison(calls)

    def bound(name: str) -> Column:
        return w.select(name).scalar()

    compared = overview.compare_periods(
        calls, (bound("p1_start"), bound("p1_end")), (bound("p2_start"), bound("p2_end")))
    return overview.show_comparison(compared)


def _trend(granularity: str, group_by: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = overview.trend(_treated(spark, sf_dir), granularity, group_by=group_by)
        return _rounded(report, "value").select("series", "period", "metric", "value")
    return run


for _granularity in ("Daily", "Weekly", "Monthly"):
    query("trend_" + _granularity.lower())(_trend(_granularity, None))
for _name, _column in DIMENSIONS.items():
    query(f"trend_by_{_name}")(_trend("Weekly", _column))


def _snapshot(group_by: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = overview.snapshot(_treated(spark, sf_dir), group_by=group_by)
        return _rounded(report, "value").select("category", "metric", "value")
    return run


query("snapshot_overall")(_snapshot(None))
for _name, _column in DIMENSIONS.items():
    query(f"snapshot_by_{_name}")(_snapshot(_column))


@query("snapshot_shown")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.show_snapshot(overview.snapshot(_treated(spark, sf_dir), group_by="Mover / Switcher"))


@query("trend_without_contact")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = overview.trend(_treated(spark, sf_dir).drop("ib_contact_calls"), "Weekly")
    return _rounded(report, "value").select("series", "period", "metric", "value")


def _without_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _treated(spark, sf_dir).withColumn("gcv_fo", F.col("total_revenue")).drop("total_revenue")


@query("trend_without_revenue")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = overview.trend(_without_revenue(spark, sf_dir), "Weekly")
    return _rounded(report, "value").select("series", "period", "metric", "value")


def _rollup_of(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """The written daily rollup of a written mart."""
    path = test_folder(spark, "mart")
    sinks.write_call_mart(calls, path)
    return refresh_rollup(spark, path, f"{path}-daily", schema=calls.schema)


@query("rollup_trend_without_contact")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = overview.trend(_rollup_of(spark, _treated(spark, sf_dir).drop("ib_contact_calls")), "Weekly")
    return _rounded(report, "value").select("series", "period", "metric", "value")


@query("rollup_trend_without_revenue")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = overview.trend(_rollup_of(spark, _without_revenue(spark, sf_dir)), "Weekly")
    return _rounded(report, "value").select("series", "period", "metric", "value")


@query("rollup_snapshot_without_orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel counts an absent column as zero, the snapshot does not know it; both by the same rollup."""
    rollup = _rollup_of(spark, _treated(spark, sf_dir).drop("orders", "credit_calls_flag"))
    report = overview.snapshot(rollup, group_by="Center").selectExpr("category", "metric", "value")
    return _rounded(report.unionByName(
        m.long(overview.summarise(rollup, "center_location AS category"), {k: m.FUNNEL[k] for k in ("NC", "CiCredit", "PCR")}, "category")
        .selectExpr("category", "concat('funnel ', metric) AS metric", "value")), "value")


@query("week_cards_without_revenue")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = overview.week_cards(_without_revenue(spark, sf_dir))
    return _rounded(cards, "value", "prior_value", "change_pct").drop("kind")


# --- agents ------------------------------------------------------------------

_CARD = ("net_conv", "top_product_mix", "total_revenue", "rev_per_call", "rev_per_order",
         "talk_time", "sold_talk_time")


@query("agent_scorecard")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = agents.agent_scorecard(_treated(spark, sf_dir))
    return agents.sort_agents(_rounded(card, *_CARD), "Rev / Call")


@query("agent_scorecard_all_members")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agents.agent_scorecard(adapter.calls(spark, sf_dir)), *_CARD)


@query("agent_search")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = agents.agent_scorecard(_treated(spark, sf_dir), search="customer#0+[1-4]*7$")
    return agents.sort_agents(_rounded(card, *_CARD), "Talk Time", ascending=True)


@query("agent_shown")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.show_agents(agents.agent_scorecard(_treated(spark, sf_dir)))


@query("roster_shown")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.show_roster(agents.roster_summary(agents.agent_scorecard(_treated(spark, sf_dir))))


@query("roster_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = agents.roster_summary(agents.agent_scorecard(_treated(spark, sf_dir)))
    return _rounded(summary, "avg_net_conv", "avg_rev_per_call", "avg_talk_time")


@query("agent_distribution")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = agents.agent_distribution(agents.agent_scorecard(_treated(spark, sf_dir)))
    return _rounded(bins, "bin_from", "bin_to")


# --- lift --------------------------------------------------------------------

_AVERAGED = lift.AVERAGED


def _weekly(spark: SparkSession, sf_dir: str, window: LiftWindow | None = None,
            selected: CallFilters = CallFilters()) -> DataFrame:
    return lift.weekly_lift(lift.weekly_scope(adapter.lift(spark, sf_dir), window, selected))


@query("lift_active_weeks")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = adapter.lift(spark, sf_dir)
    weeks = lift.active_weeks(facts, WINDOW.post_from, WINDOW.post_to)
    return lift.baseline_of(facts, weeks).groupBy("post_week", "week").agg(
        F.count(F.lit(1)).alias("baseline_rows"))


@query("lift_post_bounds")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.post_bounds(adapter.lift(spark, sf_dir))


@query("lift_kpis_by_cohort")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = lift.weekly_cohort_kpis(lift.weekly_scope(adapter.lift(spark, sf_dir)))
    return _rounded(kpis, *m.LIFT_VOLUMES, *m.LIFT)


@query("lift_kpis_by_cohort_and_mover")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = lift.weekly_cohort_kpis(lift.weekly_scope(adapter.lift(spark, sf_dir)), "mover_switcher")
    return _rounded(kpis, *m.LIFT_VOLUMES, *m.LIFT)


@query("lift_fixed_baseline")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = lift.fixed_baseline_kpis(lift.fixed_baseline(adapter.lift(spark, sf_dir), WINDOW), "call_type")
    return _rounded(kpis, *m.LIFT_VOLUMES, *m.LIFT)


@query("lift_weekly")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_weekly(spark, sf_dir), *_AVERAGED).drop("position", "kind")


@query("lift_weekly_windowed")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = CallFilters(mover_switcher=("mover", "switcher"), call_type=("Site Session",))
    return _rounded(_weekly(spark, sf_dir, WINDOW, selected), *_AVERAGED).drop("position", "kind")


@query("lift_weekly_from_table")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, facts = test_folder(spark, "lift-table"), adapter.lift(spark, sf_dir)
    lift_table.write_lift_facts(facts, path)
    selected = CallFilters(mover_switcher=("mover", "switcher"), call_type=("Site Session",))
    scope = lift.weekly_scope(lift_table.read_lift_facts(spark, path, facts.schema), WINDOW, selected)
    return _rounded(lift.weekly_lift(scope), *_AVERAGED).drop("position", "kind")


@query("lift_weekly_excluding")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = LiftWindow(WINDOW.pre_start, WINDOW.pre_end, excluded_week="01/22/2024")
    return _rounded(_weekly(spark, sf_dir, window), *_AVERAGED).drop("position", "kind")


@query("lift_volume")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.lift_volume(_weekly(spark, sf_dir))


@query("lift_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lift.lift_summary(_weekly(spark, sf_dir)), *_AVERAGED).drop("kind")


@query("lift_summary_shown")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.show_summary(lift.lift_summary(_weekly(spark, sf_dir)))


@query("lift_headlines")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = lift.lift_headlines(lift.lift_summary(_weekly(spark, sf_dir)))
    return _rounded(heads, "swing", "post_delta")


@query("lift_headlines_shown")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift.show_headlines(lift.lift_headlines(lift.lift_summary(_weekly(spark, sf_dir))))


def _lift_trend(view: str, group_by: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scope = lift.weekly_scope(adapter.lift(spark, sf_dir))
        report = lift.lift_trend(scope, view, group_by=group_by)
        return _rounded(report, "value").select("series", "week_start", "metric", "value")
    return run


for _view in lift.VIEWS:
    query(f"lift_trend_{_view}")(_lift_trend(_view, None))
    for _name, _column in LIFT_DIMENSIONS.items():
        query(f"lift_trend_{_view}_by_{_name}")(_lift_trend(_view, _column))


@query("lift_files")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, facts = test_folder(spark, "lift") + "/centre", adapter.lift(spark, sf_dir)
    # an unreadable number must come back as missing
    facts = facts.withColumn("gcv_revenue", F.when(
        F.col("order_orders") == 5, F.lit("n.a.")).otherwise(F.col("gcv_revenue").cast("string")))
    for period in ("post", "pre"):
        sinks.export_report(facts.filter(F.col("period") == period), f"{base}_{period}.csv")
    weekly = facts.filter("period = 'pre_weekly'")
    for part, week in enumerate(adapter.POST_WEEKS, 1):
        sinks.export_report(weekly.filter(F.col("post_week") == week), f"{base}_pre_weekly_{part}.csv")
    loaded = csv_files.load_lift_files(spark, base)
    return _rounded(loaded.groupBy("period", "week", "post_week", "cohort").agg(
        F.count(F.lit(1)).alias("fact_rows"), F.sum("gcv_revenue").alias("revenue"),
        F.sum("order_orders").alias("order_count"), F.sum("passed_credit_call_ind").alias("passed_count"),
        F.max("call_datetime_est").alias("last_call"),
    ), "revenue", places=2)
