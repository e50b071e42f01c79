"""Order lines rolled up to the call they belong to."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from dialtone.config import ORDER_TIME_ZONE, PREPAID_PRODUCT

PARTITION_LINES = 250_000


def effective_order_time(local: str, utc: str, zone: str = ORDER_TIME_ZONE) -> str:
    """Local order time, or the UTC time moved to the local zone."""
    moved = f"convert_timezone('UTC', '{zone}', CAST({utc} AS TIMESTAMP_NTZ))"
    return f"coalesce(CAST({local} AS TIMESTAMP_NTZ), {moved})"


def orders_since(orders: DataFrame, from_date: date, zone: str = ORDER_TIME_ZONE) -> DataFrame:
    """Order lines whose effective day is not before ``from_date``.

    The exact rule wraps the columns in functions, which no file scan can use,
    so a bound on the raw columns that is one day wider goes with it.
    """
    early = f"TIMESTAMP_NTZ '{from_date - timedelta(days=1)}'"
    coarse = f"(order_date_est >= {early} OR order_date_utc >= {early})"
    exact = f"CAST({effective_order_time('order_date_est', 'order_date_utc', zone)} AS DATE) >= DATE '{from_date}'"
    return orders.filter(f"{coarse} AND {exact}")


def dealt(orders: DataFrame, key: str = "call_id") -> DataFrame:
    """The order lines by call in partitions of about ``PARTITION_LINES``, however many there are.

    The sorts and hash tables of a join and a roll-up by call then hold no more in a task as the table grows.
    """
    lines = orders.count()
    if lines <= PARTITION_LINES:
        return orders
    least = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.repartition(max(least, -(-lines // PARTITION_LINES)), key)


def in_scope(orders: DataFrame, calls: DataFrame, key: str = "call_id") -> DataFrame:
    """Order lines of calls that are in ``calls``, dealt by call."""
    return dealt(orders, key).join(calls.select(key), key, "left_semi")


def order_rollup(orders: DataFrame, prepaid_product: str = PREPAID_PRODUCT) -> DataFrame:
    """Per call: distinct orders, expected value, and whether a line was prepaid."""
    value = "coalesce(undiscounted_gcv, 0) * coalesce(predicted_activation_rate, 0)"
    return orders.withColumn("_prepaid", F.col("product_name") == prepaid_product).groupBy("call_id").agg(
        F.expr("count(DISTINCT order_id) AS order_count"),
        F.expr(f"sum({value}) AS order_value"),
        F.expr("max(int(coalesce(_prepaid, false))) AS has_prepaid"),
    )
