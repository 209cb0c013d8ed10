"""Queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from loomlog.queries import calls, frozen, general, generated, inspect, records
from loomlog.queries.registry import ORACLES as CORE_ORACLES
from loomlog.queries.registry import QUERIES as CORE_QUERIES

__all__ = ["CORE_ORACLES", "CORE_QUERIES", "calls", "frozen", "general", "generated", "inspect", "records"]
