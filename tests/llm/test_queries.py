import pytest

from foliospark.llm import queries
from tests.compare import ROOT, assert_same


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_matches_sql(spark, key):
    assert_same(queries.queries()[key](spark, ROOT), queries.oracle_sql()[key])
