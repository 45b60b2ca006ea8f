"""Exact deduplication by a content sort.

Sampled splitters range-partition the documents by the normalised bytes, a sort inside each range
places equal texts next to each other, and full comparisons of neighbours find the runs of equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from circdesk.llm.support import durable, pieces

_KEY_BYTES = 64
_ROWS = 2000


def exact_duplicates(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and ``carry``.

    Texts are equal when they are identical after lower-casing A to Z; null counts as empty. Of
    equal texts the row with the largest doc_id stays, of several such rows exactly one; a null
    doc_id is smaller than any other. An empty table gives an empty result. Only doc_id, text and
    the columns named in ``carry`` are read, so other columns may have any name.

    The splitters are sampled from the first 64 normalised bytes, the digest of all of them and
    doc_id: keys of a fixed size, whatever the length of the texts. The doc_id in the key lets a
    text that a third of all rows share spread over many ranges. Runs that touch the edge of a range
    are joined afterwards by comparing the edge texts of neighbouring ranges, two rows per range.
    """
    return _grouped(docs, carry, False).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256",
        *[F.col("carried").getField(c).alias(c) for c in carry if c not in _OWN],
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns and their values as they were.

    The text travels once, in the sort, and comes out of it only for the first row of each run.
    """
    rest = [c for c in docs.columns if c != "text"]
    return _grouped(docs, rest, True).where("kept").select(
        *[F.col("own_text").alias(c) if c == "text" else F.col("carried").getField(c).alias(c) for c in docs.columns]
    )


def _grouped(docs: DataFrame, carry: Sequence[str], with_text: bool) -> DataFrame:
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"),
    )
    keyed = T.StructType([
        T.StructField("key", T.BinaryType()), T.StructField("digest", T.StringType()),
        *source.schema.fields,
    ])
    sorted_rows = (
        source.mapInArrow(_with_keys, keyed)
        .repartitionByRange("key", "digest", "doc_id")
        .sortWithinPartitions("key", "digest", F.col("doc_id").desc_nulls_last())
    )
    found = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()),
        T.StructField("first", T.BooleanType()), T.StructField("doc_id", T.LongType()),
        T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()), T.StructField("edge_text", T.StringType()),
        T.StructField("own_text", T.StringType()), source.schema["carried"],
    ])
    runs = durable(sorted_rows.mapInArrow(_runs(with_text), found))
    # At most two rows per range from here on to the join, which bounds the window and the broadcast.
    edges = runs.where("edge_text is not null").select("part", "run", "keep_id", "group_size", "edge_text")
    place = Window.orderBy("part", "run")
    edges = edges.withColumn(
        "starts", F.coalesce(F.lag("edge_text").over(place) != F.col("edge_text"), F.lit(True))
    ).drop("edge_text").withColumn("text_no", F.sum(F.col("starts").cast("int")).over(place))
    whole = edges.groupBy("text_no").agg(
        F.max(F.struct("keep_id", "part", "run")).alias("best"), F.sum("group_size").alias("all_size")
    )
    edges = edges.join(whole, "text_no").select(
        "part", "run", F.col("best.keep_id").alias("all_keep"), "all_size",
        ((F.col("best.part") == F.col("part")) & (F.col("best.run") == F.col("run"))).alias("wins"),
    )
    joined = runs.join(F.broadcast(edges), ["part", "run"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("wins").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("first") & F.coalesce("wins", F.lit(True))).alias("kept"),
        "text_sha256", "own_text", "carried",
    )


_OWN = {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}


def _lower(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


def _with_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, _ROWS):
        norm = _lower(batch.column("text")).cast(pa.binary())
        key = pc.binary_slice(norm, 0, _KEY_BYTES)
        digest = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in norm], pa.string())
        yield pa.RecordBatch.from_arrays(
            [key, digest, *batch.columns], names=["key", "digest", *batch.schema.names]
        )


def _runs(with_text: bool):
    """Runs of equal texts in one sorted range. A run is held back until it ends: its rows without
    their texts, at most the rows of one range, and the first row's text as it was if that is wanted."""
    def run_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run, text, own, held = -1, None, None, []

        def emit(last: bool) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            n, ids = rows.num_rows, rows.column("doc_id")
            edge = [text if run == 0 or last else None] + [None] * (n - 1)
            return pa.RecordBatch.from_arrays([
                pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int64()),
                pa.array([True] + [False] * (n - 1)), ids.combine_chunks(),
                pa.array([ids[0].as_py()] * n, pa.int64()), pa.array([n] * n, pa.int64()),
                rows.column("digest").combine_chunks(), pa.array(edge, pa.string()),
                pa.array([own] + [None] * (n - 1), pa.string()), rows.column("carried").combine_chunks(),
            ], names=["part", "run", "first", "doc_id", "keep_id", "group_size", "text_sha256", "edge_text",
                      "own_text", "carried"])

        out: list[pa.RecordBatch] = []
        for batch in pieces(batches, _ROWS):
            texts = _lower(batch.column("text")).to_pylist()
            thin = batch.select(["doc_id", "digest", "carried"])
            start = 0
            for i, t in enumerate(texts):
                if t == text:
                    continue
                if i > start:
                    held.append(thin.slice(start, i - start))
                if held:
                    out.append(emit(False))
                run, text, held, start = run + 1, t, [], i
                own = batch.column("text")[i].as_py() if with_text else None
            if texts:
                held.append(thin.slice(start))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if held:
            yield emit(True)

    return run_
