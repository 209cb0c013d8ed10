"""The core does without the optional subpackage, and every query can be named and described."""

import re
from pathlib import Path

import __spark_entry__
from loomlog.queries import CORE_ORACLES, CORE_QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_in_the_core_imports_the_optional_subpackage():
    for f in (ROOT / "loomlog").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"loomlog\.llm|from loomlog import llm", f.read_text()), f


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(CORE_QUERIES) <= set(queries) and set(CORE_ORACLES) <= set(sql) <= set(queries)
    assert all(re.fullmatch(r"[a-z]+_?\d+[a-z]?_\w+|p\d+_\w+", n) for n in queries)


def test_no_local_checkpoint():
    for f in (ROOT / "loomlog").rglob("*.py"):
        assert "localCheckpoint" not in f.read_text()
