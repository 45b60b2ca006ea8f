"""Library tables stored as Parquet, one folder or file per table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from circdesk.model.schema import schema
from circdesk.model.tables import Tables


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table under its declared schema, so no job runs to infer it."""
    return spark.read.schema(schema(name)).parquet(path)


def read_library(spark: SparkSession, folder: str) -> Tables:
    base = folder.rstrip("/")
    return Tables(**{n: partial(read_table, spark, f"{base}/{n}", n) for n in Tables.names()})


def write_library(tables: Tables, folder: str) -> None:
    """Store every table so that ``read_library`` finds it; existing tables are an error."""
    for name in Tables.names():
        getattr(tables, name).write.parquet(f"{folder.rstrip('/')}/{name}")


def rows_of(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """Literal rows typed like ``table``; columns a row leaves out are null."""
    shape = schema(table)
    return spark.createDataFrame([tuple(r.get(c) for c in shape.names) for r in rows], shape)


def library_of(spark: SparkSession, **tables: list[dict]) -> Tables:
    """A small library from literal rows; tables left out are empty."""
    return Tables(**{n: rows_of(spark, n, tables.get(n, [])) for n in Tables.names()})
