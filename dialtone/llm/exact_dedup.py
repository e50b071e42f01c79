"""Exact dedup by skew-safe combining.

Texts are equal when they agree after all whitespace is deleted. Equal texts are combined in three stages, each of
which groups by the digest and the whole normalised text, so that texts are one only if all of their content is:

    1. locally       every task combines the equal texts it reads, before anything is shuffled
    2. salted        what the tasks found meets by digest and salt, so that a text that every task holds is shared out
    3. globally      the winners of the salts, at most one for each salt, meet by digest

A stage carries the number of copies and the best row as one number, long texts before short ones and then small
ids before large ones: a copy adds nothing to the state, and a third of all rows in one group is a row a task.
Documents get the result of their group by digest. Groups of more than a part in `HOT` of all rows, which are fewer
than `HOT`, go to every task instead, so no group is one task's. If different texts ever share a digest, the
documents of those digests are matched by their whole texts.

Defined results: a null text is an empty one. The row that stays is the one with the most code points in the text
as it stands; of equally long ones the smallest id; a row without an id stays only where no equally long one has
an id. Rows that repeat id and text are copies like any other, one of them stays. Very long texts are compared
whole. An empty table gives no rows. Columns beside the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dialtone.llm.workspace import release, staged

SALTS, HOT = 32, 1_000
# Place of the text's length in the number that ranks rows; the id's part below it is less than this.
_LENGTH = 10**20
_IDS = 2**63


def normalised(text: str) -> Column:
    """The text without any whitespace."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _texts(documents: DataFrame, digest) -> DataFrame:
    content = normalised("text")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), content.alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def combined(texts: DataFrame) -> DataFrame:
    """(digest, content, copies, best): the three stages over rows of (digest, content, n_chars, doc_id)."""
    rank = f"n_chars * {_LENGTH}BD + CASE WHEN doc_id IS NULL THEN 0BD ELSE {_IDS}BD - doc_id END"
    rows = texts.select("digest", "content", F.expr(rank).alias("best"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    # Spark combines the rows of a task before it shuffles them: the local stage.
    salted = rows.groupBy("digest", "salt", "content").agg(F.count(F.lit(1)).alias("copies"), F.max("best").alias("best"))
    return salted.groupBy("digest", "content").agg(F.sum("copies").alias("copies"), F.max("best").alias("best"))


def _attached(rows: DataFrame, groups: DataFrame, key: Sequence[str], weight: str, total: int) -> DataFrame:
    """Left lookup of groups in which no large group is shuffled: `weight` says how many of the `total` rows it has."""
    large = F.col(weight) * HOT > total
    few = F.broadcast(groups.where(large))  # fewer than HOT groups have more than a part in HOT
    return rows.join(few, list(key)).unionByName(
        rows.join(few.select(*key), list(key), "left_anti").join(groups.where(~large), list(key), "left"))


def exact_groups(documents: DataFrame, digest=sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    `digest` turns a normalised text into its address; a weak one costs time and changes no result.
    """
    texts = _texts(documents, digest)
    rows = staged(texts.select("doc_id", "n_chars", "digest", sha256(F.col("content")).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "rows")
    total = rows.count()
    groups = staged(combined(texts).drop("content"), "groups")
    shared = staged(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "shared")
    if shared.isEmpty():
        placed = _attached(rows, groups, ["digest"], "copies", total)
    else:  # different texts of one digest: those documents again, by their whole texts
        alone = rows.join(shared, "digest", "left_anti")
        placed = _attached(alone, groups.join(shared, "digest", "left_anti"), ["digest"], "copies", total)
        again = texts.withColumn("text_sha256", sha256(F.col("content"))).withColumn("row", F.monotonically_increasing_id())
        again = again.join(shared, "digest", "left_semi")
        placed = placed.unionByName(again.join(combined(again), ["digest", "content"]).drop("content"))
    first = f"best div {_LENGTH}BD = n_chars AND doc_id <=> keep_id"
    kept_id = f"CASE WHEN best % {_LENGTH}BD > 0 THEN CAST({_IDS}BD - best % {_LENGTH}BD AS BIGINT) END"
    result = staged(
        placed.withColumn("keep_id", F.expr(kept_id)).select(
            "doc_id", "keep_id", F.col("copies").alias("group_size"), F.expr(first).alias("first"), "text_sha256", "n_chars", "row"), "placed")
    release(rows, groups, shared)
    # Rows that repeat the id and the text of the one that stays: only the first of them does.
    name = F.when(F.col("first"), F.concat_ws(" ", "text_sha256", F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("-"), F.col("row").cast("string")))
    named = result.withColumn("name", name)
    repeats = named.where("first").groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("stays")).where("rows > 1")
    repeats = staged(repeats, "repeats")
    if not repeats.isEmpty():
        result = _attached(named, repeats, ["name"], "rows", total).withColumn("first", F.expr("first AND coalesce(stays, row) = row"))
    return result.select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256", "n_chars")
