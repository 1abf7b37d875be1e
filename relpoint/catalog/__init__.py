"""Registered queries: each operator on the driver tables, with its SQL counterpart."""

from __future__ import annotations

from relpoint.catalog import boosting, families, frames, history, inputs, labels, schedules, scores

MODULES = (frames, families, labels, history, schedules, inputs, scores, boosting)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
