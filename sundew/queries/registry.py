"""Where the modules of this folder put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sundew.plans.events import HP_SQL, attack_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def over_events(name: str, sql: str | None = None):
    """Register a function of the canonical events; ``sql`` is what follows the common table ``hp``."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(attack_events(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH {HP_SQL}{', ' + sql.strip()[5:] if sql.strip().startswith('WITH ') else ' ' + sql}"
        return f

    return add


def over_tables(name: str, sql: str | None = None):
    """Register a function of the session and the folder of tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
