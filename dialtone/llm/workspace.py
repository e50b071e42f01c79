"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []  # the folder of a session on one machine that names none
_made: list[str] = []  # folders that were made and not deleted yet


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A cluster has to name one; a session in one process that names
    none, as in tests, has a temporary one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder for intermediate tables")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="dialtone-llm-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; `clear` deletes what is put there."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` written to the shared folder and read back: what follows starts from files that outlive executors. Rows
    lie in folders `by` the values of a column, if one is named."""
    path = new_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them is in files itself."""
    for table in tables:
        delete(table.sparkSession, table.staged_at)


def clear(spark: SparkSession, keep: int = 0, but: DataFrame | None = None) -> None:
    """Delete all folders that were made, but for the first `keep` of them and that of `but`: when the results that
    read them are written elsewhere."""
    for path in _made[keep:]:
        if but is None or path != but.staged_at:
            delete(spark, path)


def made() -> int:
    """How many folders there are now."""
    return len(_made)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000, size: int | None = None) -> Iterator[None]:
    """What is written inside sends batches of at most so many rows to Python, or rows of about `size` bytes where that
    is given: a batch of whole texts is held several times over, in the JVM's buffers and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch" if size else "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, most = spark.conf.get(name), size or rows
    held = before.removesuffix("b")  # a setting of bytes is read back with its unit
    spark.conf.set(name, str(min(most, int(held)) if held.isdigit() and int(held) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside are deleted at the end of each write."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
