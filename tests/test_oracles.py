"""Every query of the core against its SQL in DuckDB."""

import pytest

from marlstone.plans.queries import ORACLES, QUERIES
from tests.oracles import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same_rows(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    from tests.oracles import SMALL

    assert QUERIES[name](spark, SMALL).limit(1).count() == 1
