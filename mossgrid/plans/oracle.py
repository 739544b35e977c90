"""All SQL counterparts of the core queries."""

from __future__ import annotations

from mossgrid.plans import oracle_parts, oracle_reports

ORACLE: dict[str, str] = oracle_parts.ORACLE | oracle_reports.ORACLE
