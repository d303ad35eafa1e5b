"""The contract queries that have SQL, against it."""

import pytest

from keyloom.llm import queries
from tests.oracle import connect, mismatch


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name, sf):
    assert mismatch(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name]) is None
