"""The batch jobs end to end, on tables written by Spark."""

from __future__ import annotations

from dataclasses import fields

from checks import adapter
from dialtone import jobs
from dialtone.operators.filters import treatment_only
from dialtone.plans import overview
from dialtone.plans.extract import call_mart
from dialtone.sources import sinks


def test_refresh(spark, sf_dir, tmp_path):
    src = adapter.extract_sources(spark, sf_dir)
    locations = {}
    for f in fields(src):
        locations[f.name] = str(tmp_path / f.name)
        getattr(src, f.name).write.parquet(locations[f.name])
    path = str(tmp_path / "mart")
    direct = call_mart(src, adapter.EXTRACT)
    for stage in (False, True):      # a second run replaces the first
        counts = jobs.refresh_call_mart(spark, locations, adapter.EXTRACT, path, stage=stage)
        assert [tuple(r) for r in counts.collect()] == [("2024-01", direct.count())]

    def funnel(calls):
        return [tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                for r in overview.funnel_long(treatment_only(calls), "Weekly").collect()]

    written = sinks.read_call_mart(spark, path)
    rollup = jobs.refresh_rollup(spark, path, str(tmp_path / "rollup"))
    assert funnel(written) == funnel(direct) == funnel(rollup)
