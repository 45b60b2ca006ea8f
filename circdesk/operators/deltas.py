"""Turning table changes into new table versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_changes(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], set_columns: Sequence[str]
) -> DataFrame:
    """``table`` with ``set_columns`` taken from ``changes`` where a change row has the key.

    ``changes`` holds at most one row per key. A null in it overwrites: presence of the row
    decides, not the value.
    """
    renamed = changes.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in set_columns], F.lit(True).alias("_changed")
    )
    joined = table.join(renamed, list(keys), "left")
    return joined.select(
        *[
            F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in set_columns
            else F.col(c)
            for c in table.columns
        ]
    )


def add_to_stock(sach: DataFrame, per_book: DataFrame) -> DataFrame:
    """``sach`` with ``per_book.them`` (one row per book, may be negative) added to the stock."""
    joined = sach.join(per_book.select("ma_sach", "them"), "ma_sach", "left")
    stock = (F.col("so_luong") + F.coalesce("them", F.lit(0))).cast("int")
    return joined.withColumn("so_luong", stock).select(*sach.columns)


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` followed by new rows; columns the rows lack are null."""
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), True)
