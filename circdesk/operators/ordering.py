"""Running totals and consecutive ids in request order, without one task seeing a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from circdesk.operators.scratch import durable

BLOCK = "_block"
REQUEST_ORDER = ("seq", "request_id")


def in_blocks(requests: DataFrame, order: Sequence[str] = REQUEST_ORDER) -> DataFrame:
    """Cut a batch into consecutive runs of requests and remember each row's run number.

    The run is the number of the range partition the row lands in. It is written out at once,
    since a second evaluation could sample other range bounds.
    """
    return durable(requests.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id()))


def totals_before(
    rows: DataFrame,
    keys: Sequence[str],
    amounts: Sequence[str],
    order: Sequence[str] = REQUEST_ORDER,
) -> DataFrame:
    """Add ``<amount>_before``: its sum over earlier rows of the same key, 0 for the first.

    Two levels: sums per (key, block) are totalled over the blocks of a key, and the rows are
    totalled inside their own (key, block). The largest group any task sorts is one block of one
    key, whatever share of the rows that key has; the upper level sees one row per block.
    """
    keys = list(keys)
    group = [*keys, BLOCK]
    earlier_blocks = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_rows = (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*group)
        .agg(*[F.sum(a).alias(a) for a in amounts])
        .select(
            *group,
            *[F.coalesce(F.sum(a).over(earlier_blocks), F.lit(0)).alias(f"_{a}") for a in amounts],
        )
    )
    totals = {
        f"{a}_before": F.coalesce(F.sum(a).over(earlier_rows), F.lit(0)) + F.col(f"_{a}")
        for a in amounts
    }
    return (
        rows.join(starts, group).withColumns(totals).drop(*[f"_{a}" for a in amounts])
    )


def number_chosen(
    rows: DataFrame,
    chosen: Column,
    highest: Column,
    name: str,
    order: Sequence[str] = REQUEST_ORDER,
) -> DataFrame:
    """Give the chosen rows the ids ``highest + 1, highest + 2, ...`` in order, others null.

    Rows are numbered inside their block, after the rows of the earlier blocks. Only chosen rows
    are sorted. ``rows`` is read three times and should come from files.
    """
    picked = rows.where(chosen)
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per block, so neither this window nor the broadcast outgrows the partition count.
    starts = F.broadcast(
        picked.groupBy(BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*order))
    new_id = F.coalesce(highest, F.lit(0)) + F.col("_start") + place
    numbered = picked.join(starts, BLOCK).withColumn(name, new_id.cast("bigint")).drop("_start")
    others = rows.where(~F.coalesce(chosen, F.lit(False)))
    return numbered.unionByName(others.withColumn(name, F.lit(None).cast("bigint")))


def highest_id(table: DataFrame, column: str) -> Column:
    return table.select(F.max(column)).scalar()
