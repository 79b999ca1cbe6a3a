"""Queries with their SQL, and small literal tables that both sides share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def _literal(x: object) -> str:
    return "NULL" if x is None else q(x) if isinstance(x, str) else str(x)


class Cases:
    """Rows that are a DataFrame on one side and VALUES on the other."""

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]
        self.types = [c.split()[1] for c in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self, name: str = "cases") -> str:
        kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN"}
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {kinds[t]}) AS {n}" for n, t in zip(self.names, self.types))
        return f"(SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(self.names)})) AS {name}"
