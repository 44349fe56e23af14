"""All queries of the engine with their SQL, gathered from the groups beside this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import lattice

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: SQL that takes minutes on more than the smallest tables; the tests use it there.
SLOW_SQL: dict[str, str] = {}


def query(sql: str | None = None, slow: bool = False) -> Callable:
    """Registers a function of a Network under its name; its SQL continues the network's recipe
    (from a comma, further tables; or else from the final SELECT)."""

    def add(f: Callable[[lattice.Network], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lattice.Network(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            (SLOW_SQL if slow else ORACLE_SQL)[f.__name__] = lattice.SQL + (body if body.startswith(",") else "\n" + body)
        return f

    return add


from . import assurance_queries, domain_queries, geometry_queries, graph_queries, isolation_queries, label_queries, relational_queries, route_queries, span_queries, study_queries, text_queries, topology_queries  # noqa: E402, F401
