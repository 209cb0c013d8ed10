"""Every query of the core that SQL can express gives the rows of its SQL, on whole tables."""

from pathlib import Path

import oracle
import pytest

from loomlog.queries import CORE_ORACLES, CORE_QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(DATA)


@pytest.mark.parametrize("name", sorted(CORE_ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.differences(CORE_QUERIES[name](spark, str(DATA)), con, CORE_ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(CORE_QUERIES) - set(CORE_ORACLES)))
def test_runs(spark, name):
    df = CORE_QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
