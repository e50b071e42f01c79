"""Every registered query against its independent SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from checks.compare import connect, difference
from checks.oracles import oracle_sql
from checks.queries import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    rows, problem = difference(spark, con, sf_dir, name)
    assert not problem, problem
    assert rows > 0


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry_returns_rows(spark):
    result = entry_point.entry(spark)
    assert result.columns == ["period", "position", "metric", "kind", "value", "label", "shown"]
    assert result.count() == 14 * 5
