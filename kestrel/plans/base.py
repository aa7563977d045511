"""Tables and literal fixtures of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, fixture: tuple) -> DataFrame:
    """A literal fixture (schema, rows) as a DataFrame."""
    return spark.createDataFrame(fixture[1], fixture[0])


def values(fixture: tuple, name: str) -> str:
    """The same fixture as a common table of SQL."""
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n"))
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]"
        return repr(x)

    cols = ", ".join(c.split()[0] for c in fixture[0].split(", "))
    return f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in fixture[1])})"
