"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from .plans import adapter_queries, merge_queries, more_queries, news_queries, notice_queries, payload_queries, posting_queries, record_queries, signal_queries, source_queries, state_queries, text_queries, view_queries  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
