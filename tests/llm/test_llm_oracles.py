import pytest
from compare import compare, duck

from glimmer.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) == ""
