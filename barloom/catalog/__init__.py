"""The queries of the driver contract: each runs a library operator over the given tables.

Where the reference result is plain SQL, the query carries it for the cross-check.
"""

from __future__ import annotations

from barloom.catalog import evaluation, features, history, payloads, planning, scoring, trading
from barloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "features", "history", "payloads", "planning",
           "scoring", "trading"]
