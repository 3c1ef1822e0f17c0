import pytest

from clausemill.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_oracle(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], connect(sf_dir)) is None
