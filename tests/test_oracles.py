"""Every registered query against its SQL twin in DuckDB."""

import pytest

from tests.compare import connect, rows
from tests.conftest import SMALL
from tidewatch import plans


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = plans.queries()[name](spark, SMALL).toPandas()
    theirs = duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_oracle_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
