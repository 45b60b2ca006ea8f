"""Joins in which one key may hold a large share of the rows.

AQE splits a hot key by itself when both join inputs come straight from a shuffle (rows against a
stored table). It cannot when one side was aggregated on the join key, because the shuffle then
sits below the aggregate. ``few_per_key`` thins the right side of an existence join without that
effect; ``spread_join`` splits hot keys against an aggregated side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
_NULL_KEY_PIECES = 1024
_FEW = 16


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    counted: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``left.join(right, on, how)`` for inner, left, left_semi and left_anti joins, hot keys split.

    A key with more than ``rows_per_task`` left rows is cut into that many pieces: left rows take
    one piece by a hash of the row, the right row of the key is repeated once per piece. All other
    keys stay whole. At most ``count(left) / rows_per_task`` keys can be hot, which bounds the
    broadcast list of them. Null keys match nothing and are merely scattered.

    ``counted`` names a column of ``right`` that already holds the number of left rows per key
    (``right`` was aggregated from ``left``); it spares counting them again and is dropped.
    """
    on = list(on)
    if counted is None:
        hot = _pieces(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on, "_n", rows_per_task)
        right = right.join(hot, on, "left")
    else:
        hot = _pieces(right, on, counted, rows_per_task)
        right = right.withColumn("_pieces", F.expr(_PIECES.format(counted, rows_per_task)))
        right = right.drop(counted)
    no_key = " or ".join(f"`{c}` is null" for c in on)
    row = ", ".join(f"`{c}`" for c in left.columns)
    spread_left = left.join(hot, on, "left").withColumn(
        "_piece",
        F.expr(
            f"cast(pmod(xxhash64({row}), cast(if({no_key}, {_NULL_KEY_PIECES}, coalesce(_pieces, 1))"
            " as bigint)) as int)"
        ),
    )
    spread_right = right.withColumn(
        "_piece", F.expr("explode(sequence(0, coalesce(_pieces, 1) - 1))")
    )
    joined = spread_left.drop("_pieces").join(spread_right.drop("_pieces"), [*on, "_piece"], how)
    return joined.drop("_piece")


def few_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys, each at most sixteen times, as the right side of a semi or anti join.

    Repeats are combined before the shuffle, like ``distinct``. The grouping takes in a hash of
    the row, so the result is not partitioned by the keys: the join shuffles it once more, right
    below itself, and AQE stays free to split a hot key of the left side.
    """
    row = ", ".join(f"`{c}`" for c in rows.columns)
    part = F.expr(f"pmod(xxhash64({row}), {_FEW})").alias("_part")
    return rows.select(*keys, part).distinct().select(*keys)


_PIECES = "cast(ceil({0} / {1}) as int)"


def _pieces(counts: DataFrame, on: list[str], count: str, rows_per_task: int) -> DataFrame:
    """Hot keys with the number of pieces each is cut into."""
    hot = counts.where(F.col(count) > rows_per_task)
    return F.broadcast(
        hot.select(*on, F.expr(_PIECES.format(count, rows_per_task)).alias("_pieces"))
    )
