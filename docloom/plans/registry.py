"""All queries of the document pipelines and their SQL oracles."""

from __future__ import annotations

from . import queries_drawings, queries_files, queries_orders, queries_part_lists, queries_quotations

_MODULES = (queries_orders, queries_quotations, queries_part_lists, queries_drawings, queries_files)


def queries():
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
