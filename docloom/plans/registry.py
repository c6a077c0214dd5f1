"""Where queries and their SQL are registered, and literal tables that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Literal:
    """Rows that are written out and, with ``more``, rows of a given table below them.

    ``columns`` is a Spark schema, ``rows`` tuples of plain values, ``more`` a SELECT that Spark and DuckDB read alike, from
    the table ``source``; its columns come in the same order.
    """

    def __init__(self, columns: str, rows: list[tuple], more: str | None = None, source: str = "documents"):
        self.columns, self.rows, self.more, self.source = columns, rows, more, source

    @property
    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        own = spark.createDataFrame(self.rows, self.columns)
        if not self.more:
            return own
        given = spark.sql(self.more.replace("{", "{{").replace("}", "}}").replace(f"FROM {self.source}", f"FROM {{{self.source}}}"), **{self.source: table(spark, sf_dir, self.source)})
        return own.union(given.select(*(F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(given.columns, own.schema, strict=True))))

    @property
    def sql(self) -> str:
        """A parenthesised SELECT with the same rows."""
        names = self._names
        kinds = [{"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}[c.split()[1]] for c in self.columns.split(", ")]

        def value(x) -> str:
            if x is None:
                return "NULL"
            if isinstance(x, (list, tuple)):
                return "[" + ", ".join(map(value, x)) + "]"
            return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

        body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in self.rows)
        cast = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
        written = f"SELECT {cast} FROM (VALUES {body}) AS v({', '.join(names)})"
        if not self.more:
            return f"({written})"
        given = f"SELECT {cast} FROM ({self.more}) AS m({', '.join(names)})"
        return f"({written} UNION ALL {given})"
