"""Library tables stored in buckets of the slip id, for joins of lines and slips without a shuffle.

Loan lines, slips and extension requests are written with the same number of buckets of
``ma_phieu_muon``, sorted within each. The session's catalog knows the layout, so that a join or a
grouping by slip reads a bucket of each side in one task.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession

from circdesk.model.schema import DDL
from circdesk.model.tables import Tables

BY_SLIP = ("chi_tiet", "phieu_muon", "yeu_cau_gia_han")
BUCKETS = 256


def write_bucketed(tables: Tables, folder: str, buckets: int = BUCKETS) -> None:
    """Store every table under ``folder``; existing tables are an error. One file per bucket."""
    for name in Tables.names():
        rows, place = getattr(tables, name), f"{folder.rstrip('/')}/{name}"
        if name not in BY_SLIP:
            rows.write.parquet(place)
            continue
        spark, table = rows.sparkSession, f"viet_{abs(hash(place)):x}_{name}"
        laid = rows.repartition(buckets, "ma_phieu_muon")
        laid.write.format("parquet").option("path", place).bucketBy(buckets, "ma_phieu_muon").sortBy(
            "ma_phieu_muon").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the catalog entry only: the files are outside the warehouse


def read_bucketed(spark: SparkSession, folder: str, name: str, buckets: int = BUCKETS) -> Tables:
    """The tables under ``folder``; the bucketed ones are entered in the catalog as ``<name>_<table>``.

    ``buckets`` must be the number they were written with.
    """
    base, parts = folder.rstrip("/"), {}
    for table, columns in DDL.items():
        if table in BY_SLIP:
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
            spark.sql(
                f"CREATE TABLE {name}_{table} ({columns}) USING parquet "
                f"CLUSTERED BY (ma_phieu_muon) SORTED BY (ma_phieu_muon) INTO {buckets} BUCKETS LOCATION '{base}/{table}'"
            )
            parts[table] = partial(spark.table, f"{name}_{table}")
        else:
            parts[table] = partial(lambda place, columns: spark.read.schema(columns).parquet(place), f"{base}/{table}", columns)
    return Tables(**parts)
