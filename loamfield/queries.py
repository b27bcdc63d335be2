"""Registry of the queries of the analytics engine and of the SQL that says the same."""

from __future__ import annotations

from .plans import corpus, files, live, over_time, registry, review, runs, statistics, texts

_MODULES = (corpus, files, live, over_time, review, runs, statistics, texts)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
