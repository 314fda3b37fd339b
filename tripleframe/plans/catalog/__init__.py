"""Registered queries: each runs one operator over whole test tables, with its SQL where SQL can say it."""

from __future__ import annotations

from tripleframe.plans.catalog import corpus, extraction, knowledge, prompting, scoring

_MODULES = (scoring, extraction, corpus, knowledge, prompting)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
