"""Registered queries and the SQL that says what each must return.

Every query reads whole driver tables (see ``base`` for how they become
records, titles, triples and logs) and runs one operator of the library.
"""

from __future__ import annotations

from .base import ORACLES, QUERIES
from . import aggregates, filters, graphs, joins, reviews, scans, texts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
