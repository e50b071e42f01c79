"""Local Spark session for tests and benchmarks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from dialtone.sources.storage import named_folder, new_folder


def local_session(name: str, cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def test_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query that writes; where the session names no shared folder, as on one machine, a
    temporary one becomes it."""
    if not named_folder(spark):
        folder = tempfile.mkdtemp(prefix="dialtone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext._jsc.sc().conf().set("spark.checkpoint.dir", folder)  # no setting of a running session
    return new_folder(spark, name)


test_folder.__test__ = False  # not a test, whatever its name
