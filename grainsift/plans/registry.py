"""All queries and their DuckDB twins, gathered from the modules of this folder."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) function, with its DuckDB SQL where there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from grainsift.plans import agg_q, funnel, io_q, more_q, relational_q, rest_q, rules_q  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
