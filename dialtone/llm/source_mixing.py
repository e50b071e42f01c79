"""Mixing sources to target weights along a time-varying curriculum.

A source's target is its weighted share of the words to train on, at most `repeats` times its own words; what it
can't take is shared again by weight until no source is above. In training time t from 0 to 1 the source's
weight changes linearly around its mean, by its slope g. The integral of the schedule is the cumulative demand
D(t) = target * ((1 - g) t + g t^2). A source's documents stand in the order of a hash of their ids, each at the
offset where the words before it end; a second pass follows the first. A document is trained at the time t where
D(t) reaches its offset, and its position counts the words that all sources have demanded by then. The table is
range-sorted by position.

Running sums of a source are taken inside hash buckets and over the buckets' sums, so no source, however large,
is one task.

Defined results: a null text has no words; a null source is a source, the last one. A document past the target
has 0 words taken and no position. The last document of a source is taken in part, so that the words taken are
the target rounded down. Rows that repeat an id are separate documents. Without words all targets are 0. Very
long texts count whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialtone.llm.workspace import staged

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Curriculum:
    """Weights and slopes repeat over the sources in the order of their names."""

    weights: tuple[int, ...] = (3, 1, 2)
    slopes: tuple[float, ...] = (0.5, -0.5, 0.25)
    share: float = 1.5
    repeats: int = 2


def repeated(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, mix: Curriculum) -> DataFrame:
    """(source, source_size, slope, target) from (source, size): one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    totals = totals.withColumn("place", place).withColumn("weight", repeated(mix.weights, F.col("place")).cast("double"))
    totals = totals.withColumn("cap", F.col("source_size") * F.lit(float(mix.repeats)))
    # Sources reach their caps in the order of cap / weight; the level is the first that the next source can hold.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    filled = filling.rowsBetween(Window.unboundedPreceding, -1)
    still = filling.rowsBetween(0, Window.unboundedFollowing)
    demand = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(mix.share)
    level = (demand - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum("weight").over(still)
    totals = totals.withColumn("level", level).withColumn("at", F.row_number().over(filling))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))
    final = F.coalesce(F.min(fits).over(Window.partitionBy(F.lit(0)))["level"], F.lit(float("inf")))
    return totals.withColumn("target", F.least("cap", final * F.col("weight"))).select(
        "source", "source_size", repeated(mix.slopes, F.col("place")).alias("slope"), "target")


def reached(offset: Column, target: Column, slope: Column) -> Column:
    """The time at which the cumulative demand reaches an offset."""
    share = offset / target
    rest = F.lit(1.0) - slope
    root = F.sqrt(rest * rest + F.lit(4.0) * slope * share)
    return F.when(slope == 0, share).otherwise((root - rest) / (F.lit(2.0) * slope))


def mix_sources(documents: DataFrame, mix: Curriculum = Curriculum(), key: str | None = None) -> DataFrame:
    """One row per document, range-sorted by its training position: doc_id, size, source_size, target, taken,
    position, repeat_position, first_words and repeat_words (the words that each pass takes).

    `key` names a column of unique numbers that is returned too. With it, rows without an id stand in the order of
    a hash of their text and key, and so in many buckets; all other rows stand as without it."""
    own = [key] if key else []
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    if key:
        unnamed = F.md5(F.concat(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(" "), F.col(key).cast("string")).cast("binary"))
        order = F.when(F.col("doc_id").isNull(), unnamed).otherwise(order)
    sizes = staged(documents.select(
        "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), order.alias("order"), *own,
    ), "sizes")
    sizes = sizes.withColumn("bucket", F.substring("order", 1, 3))
    targets = source_targets(sizes, mix)
    whole = targets.agg(
        F.sum(F.col("target") * (F.lit(1.0) - F.col("slope"))).alias("linear"), F.sum(F.col("target") * F.col("slope")).alias("square"))

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("below"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("inner", F.sum("size").over(inside) - F.col("size"))

    same = placed["source"].eqNullSafe(buckets["source"]) & (placed["bucket"] == buckets["bucket"])
    placed = placed.join(buckets, same).select(
        "doc_id", placed["source"], "size", *own, (F.col("inner") + F.col("below")).alias("offset"))
    placed = placed.join(targets, placed["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    cut = lambda used: F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - used))
    placed = placed.withColumn("first_words", cut(F.col("offset")))
    placed = placed.withColumn("repeat_words", cut(F.col("offset") + F.col("source_size")))
    placed = placed.crossJoin(F.broadcast(whole))  # one row

    def position(offset: Column, words: str) -> Column:
        t = reached(offset, F.col("target"), F.col("slope"))
        return F.when(F.col(words) > 0, F.round(F.col("linear") * t + F.col("square") * t * t, 3))

    return placed.select(
        "doc_id", "size", "source_size", "target", (F.col("first_words") + F.col("repeat_words")).alias("taken"),
        position(F.col("offset"), "first_words").alias("position"),
        position(F.col("offset") + F.col("source_size"), "repeat_words").alias("repeat_position"), "first_words", "repeat_words",
        "offset", *own,
    ).orderBy(F.col("position").asc_nulls_last(), "offset", "doc_id", *own)
