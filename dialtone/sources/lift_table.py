"""Lift facts as a table: one folder for each period and week.

Weekly baselines repeat for every post week and are most of the facts. In folders by the week they count for, a report
on a few weeks reads the baselines of these weeks only: the weeks that have post rows are found first and prune the
folders while the report runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dialtone.schemas import LIFT_FACTS

PERIOD, WEEK = "period", "week_key"


def write_lift_facts(facts: DataFrame, path: str) -> None:
    """Write facts by period and by the week that a row counts for; weeks in ``facts`` are replaced, others stay.

    ``week_key`` is the own week of a post row, the post week of a weekly baseline and missing in the fixed baseline.
    """
    key = F.expr("CASE period WHEN 'post' THEN week WHEN 'pre_weekly' THEN post_week END")
    (
        facts.withColumn(WEEK, key).hint("rebalance", F.col(PERIOD), F.col(WEEK)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD, WEEK).parquet(path)
    )


def read_lift_facts(spark: SparkSession, path: str, schema: T.StructType = LIFT_FACTS) -> DataFrame:
    """A written table: the columns of the facts and ``week_key``."""
    fields = [f for f in schema.fields if f.name != PERIOD]
    folders = [T.StructField(c, T.StringType(), True) for c in (PERIOD, WEEK)]
    return spark.read.schema(T.StructType([*fields, *folders])).parquet(path)
