"""Registry of queries: name -> (Spark builder, DuckDB oracle SQL, check kind).

check kinds (SURVEY §2): "O" exact oracle, "R" oracle after rounding both
sides inside the query, "P" no SQL form (property tests + rows-only check).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    check: str
    sql: str | None = None
    section: str = ""
    bench: bool = True
    tags: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, check: str, sql: str | None = None, section: str = "",
             bench: bool = True):
    if check in ("O", "R") and not sql:
        raise ValueError(f"{name}: check {check} needs oracle SQL")

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, check, sql.strip() if sql else None, section, bench)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so the registry is complete."""
    from quarry.plans import (q_business, q_closed_form, q_imbalance, q_models,  # noqa: F401
                              q_quality, q_relational, q_sources, q_stats)
    return REGISTRY
