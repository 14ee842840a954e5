"""Operators that prepare text for model training, with one query for each.

Nothing else in the library imports this package.
"""

from __future__ import annotations

from barloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
