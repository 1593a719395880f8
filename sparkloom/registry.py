"""All queries of the library, each with the SQL that an independent engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "topic_coverage"
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under ``name``."""

    def register(f: Query) -> Query:
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return register


def queries() -> dict[str, Query]:
    from sparkloom import plans  # noqa: F401  registers

    return _queries


def oracle_sql() -> dict[str, str]:
    from sparkloom import plans  # noqa: F401  registers

    return _oracles
