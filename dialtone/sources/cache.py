"""Loaded data kept between reports, with a lifetime."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class CachedLoad:
    """A loader whose result is persisted and reloaded after ``ttl_seconds``.

    ``None`` keeps it for good. Lost blocks are recomputed from the source.
    """

    def __init__(
        self, load: Callable[[], DataFrame], ttl_seconds: float | None = 24 * 3600,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self._load, self._ttl, self._clock = load, ttl_seconds, clock
        self._data: DataFrame | None = None
        self._loaded_at = 0.0

    def get(self) -> DataFrame:
        expired = self._ttl is not None and self._clock() - self._loaded_at >= self._ttl
        if self._data is None or expired:
            self.clear()
            self._data = self._load().persist(StorageLevel.MEMORY_AND_DISK)
            self._loaded_at = self._clock()
        return self._data

    def clear(self) -> None:
        if self._data is not None:
            self._data.unpersist()
            self._data = None
