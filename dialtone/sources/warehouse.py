"""The seven input tables of the extract, by configured name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from dialtone import schemas
from dialtone.plans.extract import Sources
from dialtone.schemas import conform

SCHEMAS: Mapping[str, T.StructType] = {
    "agent_calls": schemas.AGENT_CALLS,
    "sessions": schemas.SESSIONS,
    "orders": schemas.ORDERS,
    "agents": schemas.AGENTS,
    "marketing": schemas.MARKETING,
    "calls": schemas.CALLS,
    "intents": schemas.INTENTS,
}


def read_table(spark: SparkSession, location: str) -> DataFrame:
    """A catalog table, or a Parquet folder if the location looks like a path."""
    return spark.read.parquet(location) if "/" in location else spark.table(location)


def load_sources(spark: SparkSession, locations: Mapping[str, str]) -> Sources:
    """All inputs, each with exactly its declared columns, none of which may be absent.

    Only declared columns are selected, so the scans read no others.
    """
    missing = sorted(set(SCHEMAS) - set(locations))
    if missing:
        raise ValueError("no location for: " + ", ".join(missing))
    return Sources(**{
        role: conform(read_table(spark, locations[role]), schema, role) for role, schema in SCHEMAS.items()
    })
