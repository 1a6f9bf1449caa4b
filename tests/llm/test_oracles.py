"""The numbered queries that SQL can express, against DuckDB."""

import pytest

from marlstone.llm.queries import ORACLES, QUERIES
from tests.oracles import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])
