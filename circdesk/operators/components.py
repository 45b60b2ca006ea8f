"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circdesk.operators.scratch import durable
from circdesk.operators.skew import ROWS_PER_TASK, spread_join


def components(pairs: DataFrame, a: str, b: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``node`` and ``component``, its smallest node, of every node with a pair to another one.

    Every node's larger neighbours are tied to its smallest one, then every node and its smaller
    neighbours to the smallest of these, until nothing changes: the number of steps grows with the
    logarithm of the longest path. A node with very many neighbours is spread over tasks.
    """
    mark = {"n": F.count(F.lit(1)), "sum": F.sum(F.expr("pmod(xxhash64(u, v), 1000000007)"))}
    edges, seen = durable(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), **mark)
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_c"))
        large = spread_join(both.where("v > u"), low, ["u"], "inner", counted="_c", rows_per_task=rows_per_task)
        large = durable(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_c"))
        small = spread_join(large, low, ["u"], "inner", counted="_c", rows_per_task=rows_per_task).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, now = durable(small.where("u <> v").distinct(), **mark)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
