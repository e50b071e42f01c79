"""The last long call of each agent and day, kept between refreshes of the mart.

A few numbers for each agent and day stand for all facts before a refresh: what the as-of match would find there.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialtone.functions.periods import month_key
from dialtone.sources.storage import discard, staged

MONTH = "call_month"
SCHEMA = (
    "employeeid BIGINT, day DATE, anchor_at TIMESTAMP_NTZ, registered_anchors BIGINT, other_anchors BIGINT, "
    f"smallest STRUCT<call_id: BIGINT, registered: BOOLEAN>, {MONTH} STRING"
)


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept state, if there is one already."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def carried_into(spark: SparkSession, path: str, day: date) -> DataFrame | None:
    """One row per agent: its last long call before ``day``."""
    state = read_state(spark, path)
    if state is None:
        return None
    last = "max(struct(anchor_at, registered_anchors, other_anchors, smallest)) AS last"
    earlier = state.filter((F.col(MONTH) <= f"{day:%Y-%m}") & (F.col("day") < F.lit(day)))
    return earlier.groupBy("employeeid").agg(F.expr(last)).select("employeeid", "last.*")


def write_state(days: DataFrame, path: str, since: date) -> None:
    """Replace the days from ``since`` on; earlier days of its month stay as they are."""
    spark, month = days.sparkSession, f"{since:%Y-%m}"
    kept, stored = None, read_state(spark, path)
    new = days.withColumn(MONTH, F.expr(month_key("day")))
    if stored is not None and since.day > 1:
        kept = staged(stored.filter((F.col(MONTH) == month) & (F.col("day") < F.lit(since))), "kept-state")
        new = new.unionByName(kept)
    new.hint("rebalance", F.col(MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    if kept is not None:
        discard(kept)
