from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from checks.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
