"""Registered queries over the derived views, and their SQL."""

from __future__ import annotations


def _load() -> None:
    from perilframe.plans import cell_queries, hazard_queries, io_queries, risk_queries  # noqa: F401


def queries() -> dict:
    _load()
    from perilframe.plans.registry import QUERIES

    return QUERIES


def oracle_sql() -> dict:
    _load()
    from perilframe.plans.registry import ORACLES

    return ORACLES
