"""Registered queries: every operator of the survey that runs on the driver tables."""

from __future__ import annotations

from .registry import ORACLES, QUERIES


def _load():
    from . import dedup_queries, store_queries, stream_queries, table_queries  # noqa: F401  (registration side effects)


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
