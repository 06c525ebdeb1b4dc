"""Query registry: key -> (Spark job over a data folder, DuckDB check query or None)."""

from __future__ import annotations

from collections.abc import Callable

from palisade.oracle.sql import compose

JOBS: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(job: Callable) -> Callable:
        if key in JOBS:
            raise ValueError(f"duplicate query {key}")
        JOBS[key] = job
        if sql is not None:
            CHECKS[key] = sql
        return job

    return register


def checks() -> dict[str, str]:
    return {key: compose(sql) for key, sql in CHECKS.items()}
