"""Keep-latest dedup and key uniqueness checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_version(
    df: DataFrame, key: str, at: str, tie_break: Sequence[Column | str] = ()
) -> DataFrame:
    """One row per ``key``: the newest by ``at``, missing times last.

    ``tie_break`` orders rows of equal time. Spark keeps one row per key and
    input partition before the shuffle, so a key with many versions moves no
    more rows than there are input partitions.
    """
    newest = Window.partitionBy(key).orderBy(
        F.col(at).desc_nulls_last(),
        *[F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in tie_break],
    )
    return df.withColumn("_version", F.row_number().over(newest)).filter("_version = 1").drop("_version")


def uniqueness_report(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per table: how far its join key is from being unique.

    A lookup whose key repeats multiplies the calls it is joined to; this
    report shows by how much before the extract is run.
    """
    def one(name: str, df: DataFrame, key: str) -> DataFrame:
        per_key = (
            df.filter(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("copies"))
        )
        return per_key.agg(
            F.count(F.lit(1)).alias("key_count"),
            F.count_if(F.col("copies") > 1).alias("repeated_keys"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"),
            F.coalesce(F.max("copies"), F.lit(0)).alias("max_copies"),
        ).select(F.lit(name).alias("table_name"), "*")

    return reduce(DataFrame.unionByName, [one(n, df, k) for n, (df, k) in tables.items()])
