"""Registered queries and their SQL, by name."""

from __future__ import annotations

from . import jobs, signals, statistics

QUERIES: dict = {}
SQL: dict = {}
for _family in (statistics, signals, jobs):
    QUERIES |= _family.QUERIES
    SQL |= _family.SQL
