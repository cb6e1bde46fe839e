"""All registered queries of the similarity engine."""

from __future__ import annotations

from lumigrid.queries import images, io, retrieval, search, storage, tables  # noqa: F401
from lumigrid.queries.base import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
