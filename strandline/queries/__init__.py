"""Registered queries over the panel operators, and their SQL."""

from . import audits, etl, evaluation, operators52, selection

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (operators52, etl, evaluation, selection, audits):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
