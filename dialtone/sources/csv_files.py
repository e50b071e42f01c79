"""CSV inputs of the reports: monthly call files and lift files."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dialtone.schemas import (
    CALL_MART, LIFT_FACTS, LIFT_NUMERIC, missing_to_null, to_number, to_timestamp_strict, typed,
)

CALL_FILES = "agent_calls_*.csv"
_OPTIONS = {"header": True, "escape": '"', "multiLine": True, "mode": "FAILFAST"}


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that match a pattern; none at all is an error.

    Only names are read. Spark does the listing, so any file system it knows
    works. A folder that matches, such as one written by Spark, is one entry,
    and only one row per entry comes back, however many files it has.
    """
    name = pattern.rstrip("/").rsplit("/", 1)[-1]
    # the path up to its first part that matches, else all of it
    entry = F.regexp_extract("path", "^(.*?/" + _as_regex(name) + ")(?:/|$)", 1)
    try:
        found = spark.read.format("binaryFile").load(pattern).select("path")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no files match {pattern}") from None
        raise
    entries = found.select(F.when(entry != "", entry).otherwise(F.col("path")).alias("entry")).distinct().collect()
    if not entries:
        raise FileNotFoundError(f"no files match {pattern}")
    return sorted(row.entry for row in entries)


def _as_regex(name: str) -> str:
    """A file-name pattern of ``*`` and ``?`` as a regular expression of one path part."""
    return "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in name)


def read_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files put together by column name, every column as text.

    Entries with equal headers are read together; a column that one does not
    have is NULL in its rows. The header of an entry is taken from its first
    file, and a file inside it that has another one fails the job, as does a row
    with more or fewer fields than the header. Quoted texts may hold line ends,
    so a file is read by one task.
    """
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    reader = lambda: spark.read.options(**_OPTIONS)
    with ThreadPoolExecutor(8) as pool:
        headers = pool.map(lambda path: tuple(reader().csv(path).columns), paths)
    for path, header in zip(paths, headers):
        by_header[header].append(path)
    parts = [
        reader().option("enforceSchema", False)
        .schema(T.StructType([T.StructField(c, T.StringType(), True) for c in header]))
        .csv(same)
        for header, same in by_header.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_call_files(spark: SparkSession, folder: str, pattern: str = CALL_FILES) -> DataFrame:
    """All monthly call files of a folder as call-mart rows."""
    return typed(read_texts(spark, list_files(spark, f"{folder}/{pattern}")), CALL_MART)


def load_lift_files(spark: SparkSession, file_base: str) -> DataFrame:
    """Lift facts of one centre: ``_post`` and ``_pre`` file and one or more
    ``_pre_weekly_*`` files, all of which must exist.

    Times must be well formed; numbers that are not become NULL.
    """
    paths = [
        path
        for suffix in ("_post.csv", "_pre.csv", "_pre_weekly_*.csv")
        for path in list_files(spark, file_base + suffix)
    ]
    texts = read_texts(spark, paths)
    known = {f.name: f.dataType.typeName() for f in LIFT_FACTS.fields}

    def cast(name: str):
        text = missing_to_null(F.col(f"`{name}`"))
        if name in LIFT_NUMERIC:
            text = to_number(text)
        elif known.get(name) == "timestamp_ntz":
            text = to_timestamp_strict(text)
        return text.alias(name)

    return texts.select(*[cast(c) for c in texts.columns])
