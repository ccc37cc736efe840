import pytest
from compare import compare, duck

from glimmer.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare(df, con, ORACLES[name]) == ""
