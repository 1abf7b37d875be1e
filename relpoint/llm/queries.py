"""Queries of this package by name, with their SQL where SQL can state them."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "line_dedup",
    "language_model",
    "decontaminate",
    "simhash",
    "paragraph_dedup",
    "licenses",
    "digest_index",
    "packing",
    "quality",
    "url_filter",
    "hard_negatives",
    "collocations",
    "personal_data",
)


def _all(table: str) -> dict:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"relpoint.llm.{name}"), table)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
