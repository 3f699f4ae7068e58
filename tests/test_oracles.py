"""Every registered query with SQL agrees with it at the smallest scale."""

import pytest

from check import connect, differences
from skein.queries import ORACLES, QUERIES

SLOW = {"line_order", "contraction", "guided_seeding"}


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, folder, duck):
    got = QUERIES[name](spark, folder).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert differences(got, want) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(name, spark, folder):
    assert QUERIES[name](spark, folder).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
