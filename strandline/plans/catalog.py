"""All registered queries: importing a module of queries registers them."""

from __future__ import annotations

from strandline.plans import fold_queries, ingest_queries, job_queries, many_queries, mined_queries, portfolio_queries, queries, run_queries, selection_queries, served_queries, signal_queries, stamp_queries, statement_queries, universe_queries  # noqa: F401
from strandline.plans.registry import FOUND, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(FOUND)


def all_sql() -> dict[str, str]:
    return dict(SQL)
