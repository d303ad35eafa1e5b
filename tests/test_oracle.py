"""Every registered keyspace query against its oracle at sf0.001."""

import pytest

import keyloom.plans  # noqa: F401
from keyloom.registry import REGISTRY
from tests.oracle import connect, mismatch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.oracle])
def test_matches_oracle(spark, con, name):
    assert mismatch(REGISTRY[name].build(spark, SF), con, REGISTRY[name].oracle) is None


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.oracle])
def test_rows_only(spark, name):
    assert REGISTRY[name].build(spark, SF).count() > 0
