"""The folder's tests need the optional subpackage."""

import pytest

pytest.importorskip("loomlog.llm.queries")
