"""Calendar buckets. A bucket is always keyed by its first DATE."""

from __future__ import annotations

# Granularity names, their calendar unit and their label pattern.
GRANULARITIES = {
    "Daily": ("day", "MMM dd"),
    "Weekly": ("week", "MMM dd"),
    "Monthly": ("month", "MMM yyyy"),
}


def period_start(day: str, granularity: str) -> str:
    """First day of the day, Monday week or month that ``day`` lies in."""
    unit, _ = GRANULARITIES[granularity]
    return f"CAST({day} AS DATE)" if unit == "day" else f"trunc({day}, '{unit}')"


def period_label(start: str, granularity: str) -> str:
    """Display text of a bucket; not unique over years, so never a key."""
    return f"date_format({start}, '{GRANULARITIES[granularity][1]}')"


def month_key(day: str) -> str:
    """Month as ``yyyy-MM``, the partition key of a written call mart."""
    return f"date_format({day}, 'yyyy-MM')"


def weekday_name(day: str) -> str:
    return f"date_format({day}, 'EEEE')"
