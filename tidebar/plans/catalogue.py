"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tidebar.plans import market, periods, research, scale

QUERIES: dict = {}
SQL: dict = {}
for _module in (market, research, scale, periods):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
