"""Registered queries and their SQL twins; SQL is assembled from named common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], text: str) -> None:
    """Name a table expression (or several in one text) and the names it builds on."""
    _CTES[name] = (needs, text.strip())


def sql(body: str, *needs: str) -> str:
    """``body`` behind the table expressions it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    head = ",\n".join(_CTES[n][1] for n in order)
    return (f"WITH RECURSIVE {head}\n" if order else "") + body.strip()


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, for comparison; -0 becomes 0."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0::DOUBLE AS {name or expr}"
