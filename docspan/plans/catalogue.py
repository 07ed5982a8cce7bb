"""The catalogue of reference queries: each key has a Spark query and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    found: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name, with its oracle."""

        def add(f: Query) -> Query:
            self.found[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def _modules() -> list[Catalogue]:
    from docspan.plans import detail_queries, group_queries, rule_queries, score_queries, source_queries, spatial_queries, stream_queries, text_queries

    return [text_queries.CATALOGUE, group_queries.CATALOGUE, spatial_queries.CATALOGUE, score_queries.CATALOGUE, rule_queries.CATALOGUE, detail_queries.CATALOGUE, source_queries.CATALOGUE, stream_queries.CATALOGUE]


def queries() -> dict[str, Query]:
    return {k: q for c in _modules() for k, q in c.found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for c in _modules() for k, q in c.oracles.items()}
