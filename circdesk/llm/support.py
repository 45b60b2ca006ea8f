"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from circdesk.operators.scratch import durable

# A word is a run of characters other than the six ASCII spaces; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))), F.lit(0)).cast("long")


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``rows`` rows, so that long texts don't pile up in a worker."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: ``node`` and ``component_id``, its smallest node.

    Alternating large-star and small-star rounds. Each round takes minima with a map-side combine
    and joins them back to the rows, so a node with very many links is never gathered in one task.
    Rounds grow with the logarithm of the longest path. Nodes without links are not returned.
    """
    spark = links.sparkSession
    edges = links.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where("u <> v").distinct()
    edges, seen = durable(edges, n=F.count(F.lit(1)), mark=F.sum(F.expr("xxhash64(u, v) % 1000000007")))
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, now = durable(
            small.where("u <> v").distinct(),
            n=F.count(F.lit(1)), mark=F.sum(F.expr("xxhash64(u, v) % 1000000007")),
        )
        if now == seen:
            break
        seen = now
    if not seen["n"]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return stars.unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )


def roots(near: np.ndarray) -> np.ndarray:
    """For each row of a small symmetric 0-1 matrix, the first row of its connected component."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low
