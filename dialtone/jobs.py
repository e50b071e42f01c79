"""Batch jobs: what a scheduler would run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dialtone.config import ExtractConfig
from dialtone.operators.measures import ROLLUP_KEYS, daily_rollup
from dialtone.plans.extract import call_mart, deduplicated_calls, membership_state, registered_calls, scoped_calls
from dialtone.schemas import CALL_MART
from dialtone.sources import anchor_state, lift_table, sinks
from dialtone.sources.csv_files import load_lift_files
from dialtone.sources.storage import discard, staged
from dialtone.sources.warehouse import load_sources


def refresh_call_mart(
    spark: SparkSession, locations: Mapping[str, str], cfg: ExtractConfig, path: str,
    fmt: str = "parquet", stage: bool = False, state_path: str | None = None,
) -> DataFrame:
    """Run the extract, write it by month and return the rows of each month that was written.

    A refresh from the middle of a month keeps the days of that month that are stored already. A call that is stored
    under an earlier day and has a newer version in this run is taken out there, whether or not the new version
    belongs to the mart, as in one run over all days; only the months that hold such calls are written again. The
    counts come from notes on the days of each month, which are kept beside the mart.

    With ``stage`` the newest versions of the calls are written to the shared folder first, so that the source is
    read once, which pays off when reading it is expensive.

    ``state_path`` keeps, for each agent and day, the last long call: short calls from ``from_date`` on then find
    their anchors before it without a look at older facts, and the state is brought up to date. A call that moved
    to a later day still counts there for the day it was stored under.
    """
    src = load_sources(spark, locations)
    calls = deduplicated_calls(scoped_calls(src, cfg))
    if stage:
        calls = staged(calls, "newest-calls")
    before = anchor_state.carried_into(spark, state_path, cfg.from_date) if state_path else None
    mart = call_mart(src, cfg, calls=calls, carried=before)
    held = sinks.write_call_mart(mart, path, fmt, since=cfg.from_date, replaced=scoped_calls(src, cfg).select("call_id"))
    if state_path:
        anchor_state.write_state(membership_state(calls, registered_calls(src, cfg), cfg), state_path, cfg.from_date)
    if stage:
        discard(calls)
    sinks.note_days(spark, path, fmt, mart.schema, since=cfg.from_date, also=held)
    days = sinks.read_days(spark, path)
    written = days.filter((F.col(sinks.MONTH) >= f"{cfg.from_date:%Y-%m}") | F.col(sinks.MONTH).isin(held))
    return written.groupBy(sinks.MONTH).agg(F.sum("saved_rows").alias("saved_rows")).orderBy(sinks.MONTH)


def refresh_rollup(
    spark: SparkSession, mart_path: str, rollup_path: str, from_date: date | None = None, fmt: str = "parquet",
    schema: T.StructType = CALL_MART, also: Sequence[str] = (),
) -> DataFrame:
    """Write the daily rollup of a written mart by month and return it.

    All overview and agent reports give the same results on the rollup, which
    has a row per day and combination of dimensions however many calls there are.
    With ``from_date`` only the months from its month on are read and replaced, and those of ``also``: the earlier
    months that a refresh of the mart has written again.
    """
    mart = sinks.read_call_mart(spark, mart_path, fmt, schema)
    if from_date is not None:
        mart = mart.filter((F.col(sinks.MONTH) >= f"{from_date:%Y-%m}") | F.col(sinks.MONTH).isin(*also))
    rollup = daily_rollup(mart, [sinks.MONTH, *ROLLUP_KEYS])
    (
        rollup.hint("rebalance", F.col(sinks.MONTH)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(sinks.MONTH).parquet(rollup_path)
    )
    types = {f.name: f for f in rollup.schema.fields}
    month = types.pop(sinks.MONTH)
    return spark.read.schema(T.StructType([*types.values(), month])).parquet(rollup_path)


def load_lift_table(spark: SparkSession, file_base: str, path: str) -> DataFrame:
    """Put the lift files of a centre into a table by period and week, and return it."""
    lift_table.write_lift_facts(load_lift_files(spark, file_base), path)
    return lift_table.read_lift_facts(spark, path)
