"""Left lookups that keep the row counts of a plain left join without its skew.

A lookup table whose key repeats multiplies the rows it is joined to. Instead of
shuffling the repeats, a table is first reduced to (key, attributes, copies);
the copies of all lookups are multiplied and the rows repeated once at the end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def counted(table: DataFrame, key: Mapping[str, Column | str], attributes: Mapping[str, Column | str],
            copies: str) -> DataFrame:
    """(key, attributes, copies) of a lookup table; rows without key are left out."""
    def named(cols: Mapping[str, Column | str]) -> list[Column]:
        return [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()]

    return (
        table.select(*named(key), *named(attributes))
        .filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in key]))
        .groupBy(*key, *attributes)
        .agg(F.count(F.lit(1)).alias(copies))
    )


def counted_values(table: DataFrame, key: str, attribute: Column, values: Sequence[str], counts: str) -> DataFrame:
    """(key, counts) of a lookup whose attribute has few ``values``: how many rows of a key have each of them.

    The state of a key is a number for each value, so one shuffle by the key serves the aggregation and the join that
    follows. A row of another value is an error.
    """
    known = table.select(key, attribute.alias("_value")).filter(F.col(key).isNotNull())
    wrong = F.raise_error(F.concat(F.lit("not a known value: "), F.coalesce("_value", F.lit("NULL")))).cast("int")
    at = F.coalesce(*[F.when(F.col("_value") == v, F.lit(i)) for i, v in enumerate(values)], wrong)
    numbers = known.select(key, at.alias("_at")).groupBy(key).agg(
        *[F.count_if(F.col("_at") == i).alias(f"_n{i}") for i in range(len(values))])
    return numbers.select(key, F.array(*[F.col(f"_n{i}") for i in range(len(values))]).alias(counts))


def unfolded(df: DataFrame, counts: str, values: Sequence[str], attribute: str, copies: str) -> DataFrame:
    """A row for each value that the counts of a row have, with the value and its number of copies; a row without
    counts, whose key the lookup does not have, stays one, without both."""
    each = ", ".join(f"if({counts}[{i}] > 0, struct('{v}' AS {attribute}, {counts}[{i}] AS {copies}), NULL)" for i, v in enumerate(values))
    return df.selectExpr("*", f"inline_outer(array_compact(array({each})))").drop(counts)


def attach(df: DataFrame, lookup: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left lookup. The join strategy is left to the optimizer: it broadcasts a
    lookup whose measured size is below the session's threshold and otherwise
    merges, splitting hot keys of ``df`` adaptively."""
    return df.join(lookup, on, "left")


def member_flag(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Add whether ``key`` occurs in ``members``; rows are never multiplied."""
    distinct = members.select(key).filter(f"{key} IS NOT NULL").distinct()
    return df.join(distinct.selectExpr("*", f"true AS {flag}"), key, "left").withColumn(
        flag, F.expr(f"coalesce({flag}, false)"))


def repeat_rows(df: DataFrame, copies: str, block: int = 10_000) -> DataFrame:
    """Every row as often as the expression ``copies`` says, through arrays of
    about ``block`` items at most, however large the number is."""
    kept = df.columns
    return (
        df.selectExpr("*", f"bigint({copies}) AS _copies").filter("_copies > 0")
        .selectExpr("*", f"explode(sequence(0L, (_copies - 1) div {block})) AS _block")
        .selectExpr("*", f"explode(sequence(1L, least({block}L, _copies - _block * {block}))) AS _item")
        .select(*kept)
    )
