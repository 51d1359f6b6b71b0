"""The query catalogue over the input tables."""

from __future__ import annotations

from loamworks.plans import assets, ledgers, media, production, relational, signals, streams, texts, values

PARTS = [relational, texts, values, media, streams, production, ledgers, signals, assets]


def queries() -> dict:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
