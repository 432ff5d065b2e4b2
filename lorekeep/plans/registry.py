"""All registered core queries and their SQL."""

from __future__ import annotations

from lorekeep.plans import agent, knowledge, problems, retrieval, usage

MODULES = [problems, retrieval, usage, knowledge, agent]


def core_queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
