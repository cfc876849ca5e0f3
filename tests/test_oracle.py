"""Every named query against its SQL, on the smallest data set."""

import compare
import pytest

from hotgrid import plans

FOLDER = "/root/testdata/sf0.001"
ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    n, problems = compare.compare(spark, con, FOLDER, plans.queries()[name], ORACLES.get(name))
    assert not problems, problems


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(plans.queries())
