"""Every query of the subpackage that SQL can express gives the rows of its SQL; the others run with distinct columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402
from loomlog.llm.queries import ORACLES, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert oracle.differences(QUERIES[name](spark, str(DATA)), oracle.connection(DATA), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    df.collect()
