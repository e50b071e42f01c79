"""The written call mart and exported reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dialtone.functions.periods import month_key
from dialtone.schemas import CALL_MART
from dialtone.sources.storage import discard, remove, staged

MONTH = "call_month"
# Columns that reports filter by most, in the order of the rows of a file.
CLUSTERED = ("call_date_est", "center_location")
# CSV text of a time; the default pattern would drop the microseconds.
_CSV = {
    "header": True, "escape": '"', "multiLine": True, "mode": "FAILFAST",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


# A CSV file is read by one task, as texts may hold line ends.
_CSV_ROWS = 1_000_000


def _stored(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame | None:
    """The mart as it is stored, if there is one already."""
    try:
        return read_call_mart(spark, path, fmt, schema)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _months(rows: DataFrame) -> list[str]:
    return sorted(r[0] for r in rows.select(MONTH).distinct().collect())


def _kept_days(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType, since: date, replaced: DataFrame | None
) -> tuple[DataFrame | None, list[str]]:
    """Stored rows that have to be written again: those of the days before ``since`` of its month, and of earlier
    months that hold a replaced call, without those calls. And the names of these earlier months."""
    stored, month = _stored(spark, path, fmt, schema), f"{since:%Y-%m}"
    if stored is None:
        return None, []
    early = stored.filter((F.col(MONTH) == month) & (F.col("call_date_est") < F.lit(since)))
    if replaced is None:
        return staged(early, "kept-days"), []
    ids = staged(replaced.select("call_id").filter("call_id IS NOT NULL").distinct(), "replaced-calls")
    # the ids of the earlier months, and no other column, tell which of them are touched
    held = _months(stored.filter(F.col(MONTH) < month).select("call_id", MONTH).join(ids, "call_id", "left_semi"))
    touched = early.unionByName(stored.filter(F.col(MONTH).isin(held))) if held else early
    # months are overwritten, so they can't be read while that happens
    kept = staged(touched.join(ids, "call_id", "left_anti").select(*stored.columns), "kept-days")
    discard(ids)
    return kept, held


def write_call_mart(
    mart: DataFrame, path: str, fmt: str = "parquet", since: date | None = None, replaced: DataFrame | None = None,
) -> list[str]:
    """Write the mart in one folder per call month.

    Months in ``mart`` are replaced and others stay as they are; calls without
    a date are left out. ``since`` says that ``mart`` has no day before it: the
    stored earlier days of its month are then kept. ``replaced`` holds the
    call ids that the run has looked at: their rows of earlier days are
    superseded, so a call that moved to a later day is there once. Only the
    earlier months that hold such a call are written again; they are returned.
    The rows are rebalanced by month first, so that a month is a few files of
    good size and a big month is many; inside a file they are in the order of
    day and centre, so that a filter on these reads a part of it.
    """
    spark, kept, held = mart.sparkSession, None, []
    if since is not None and (since.day > 1 or replaced is not None):
        kept, held = _kept_days(spark, path, fmt, mart.schema, since, replaced)
    months = mart.filter(F.col("call_date_est").isNotNull()).withColumn(MONTH, F.expr(month_key("call_date_est")))
    if kept is not None:
        months = months.unionByName(kept)
    order = [c for c in (MONTH, *CLUSTERED) if c in months.columns]
    writer = (
        months.hint("rebalance", F.col(MONTH)).sortWithinPartitions(*order).write
        .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH)
    )
    if fmt == "csv":
        writer = writer.options(**_CSV).option("maxRecordsPerFile", _CSV_ROWS)
    writer.format(fmt).save(path)
    if kept is not None:
        _remove_emptied(spark, path, fmt, mart.schema, since, kept, held)
        discard(kept)
    return held


def _remove_emptied(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType, since: date, kept: DataFrame, held: list[str]
) -> None:
    """Folders of months whose last calls moved away: nothing was written over them."""
    left, month = set(_months(kept)), f"{since:%Y-%m}"
    emptied = [m for m in held if m not in left]
    if month not in left:
        early = read_call_mart(spark, path, fmt, schema).filter((F.col(MONTH) == month) & (F.col("call_date_est") < F.lit(since)))
        emptied += [] if early.isEmpty() else [month]
    for name in emptied:
        remove(spark, f"{path}/{MONTH}={name}")
        remove(spark, f"{_days_path(path)}/{MONTH}={name}")


def _days_path(path: str) -> str:
    return path.rstrip("/") + "-days"


def note_days(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = CALL_MART,
    since: date | None = None, also: Sequence[str] = (),
) -> None:
    """Write down, beside the mart, the first and last day and the rows of each month and population.

    Only months from that of ``since`` on, and those of ``also``, are read, and two columns of them. With the
    notes the bounds of the mart are known without a look at its rows.
    """
    mart = read_call_mart(spark, path, fmt, schema)
    if since is not None:
        mart = mart.filter((F.col(MONTH) >= f"{since:%Y-%m}") | F.col(MONTH).isin(*also))
    keys = [MONTH, *(["membership"] if "membership" in mart.columns else [])]
    noted = mart.groupBy(*keys).agg(
        F.min("call_date_est").alias("first_day"), F.max("call_date_est").alias("last_day"), F.count(F.lit(1)).alias("saved_rows"))
    noted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(_days_path(path))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The notes on a mart: call_month, membership (where it has one), first_day, last_day, saved_rows."""
    return spark.read.option("basePath", _days_path(path)).parquet(_days_path(path)).withColumn(MONTH, F.col(MONTH).cast("string"))


def read_call_mart(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = CALL_MART
) -> DataFrame:
    """A written mart, with ``call_month`` to prune by."""
    schema = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType(), True)])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**_CSV).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def month_counts(mart: DataFrame) -> DataFrame:
    """Rows per call month, as reported after a write."""
    month = F.expr(MONTH if MONTH in mart.columns else month_key("call_date_est"))
    return (
        mart.filter(F.col("call_date_est").isNotNull())
        .groupBy(month.alias(MONTH)).agg(F.count(F.lit(1)).alias("saved_rows"))
        .orderBy(MONTH)
    )


# Field separator of each export format.
SINGLE_FILE_ROWS = 100_000
SEPARATORS = {"csv": ",", "tsv": "\t"}


def export_report(report: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> None:
    """Write a report with a header row.

    A sorted report is written as files that are in order one after another.
    ``single_file`` is for reports of fixed size, such as one row per metric:
    what makes the report still runs in parallel, but it then comes to one task,
    and a report of more than ``SINGLE_FILE_ROWS`` rows is an error.
    """
    writer = lambda df: df.write.mode("overwrite").options(**_CSV).option("sep", SEPARATORS[fmt])
    if not single_file:
        return writer(report).csv(path)
    order = F.monotonically_increasing_id()  # rises from one sorted file to the next
    made = staged(report.withColumn("_row", order).limit(SINGLE_FILE_ROWS + 1), "report")
    try:
        if made.count() > SINGLE_FILE_ROWS:
            raise ValueError(f"a report of more than {SINGLE_FILE_ROWS} rows is not one file")
        writer(made.repartition(1).sortWithinPartitions("_row").drop("_row")).csv(path)
    finally:
        discard(made)
