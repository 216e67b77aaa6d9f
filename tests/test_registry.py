import pytest

from originlake.plans.registry import ORACLES, QUERIES
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got = rows_of(QUERIES[name](spark, SF))
    want = rows_of_sql(ORACLES[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    assert got[1] or name == "no_cover_empty"
