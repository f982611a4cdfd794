"""All queries of the library with the SQL that checks them."""

from __future__ import annotations

from .plans import attribution_queries, etl_queries, graph_queries, stratified_queries, statistics_queries, stream_queries  # noqa: F401
from .plans._register import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
