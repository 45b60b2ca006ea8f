"""Packing token pieces into sequences by bounded-space online best-fit.

A task keeps a fixed number of open bins. Which amounts of free space occur among them is noted in
a bitset; the next piece goes where the least space is left over. When one bin too many is open,
the fullest is closed. Bins still open at the end of a task are packed once more, several tasks'
at a time, until one task is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circdesk.llm.support import durable
from circdesk.llm.tokens import crc, cut, encoder, slices, split

CAPACITY = 1024
OPEN_BINS = 4096
_FAN_IN = 16


class Bins:
    """Open bins by free space. Bit f of ``some`` is set while a bin with f free places is open."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most, self.open, self.some = capacity, most, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int, new: int) -> tuple[int, int, int | None]:
        """Put a piece into the best bin, or into the bin ``new``: (bin, offset there, bin closed)."""
        fitting = self.some >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, new
        left = space - length
        closed = None
        if left:
            self.by_space[left].append(bin_)
            self.some |= 1 << left
            self.open += 1
            if self.open > self.most:
                closed = self._take((self.some & -self.some).bit_length() - 1)
        return bin_, self.capacity - space, closed

    def _take(self, space: int) -> int:
        found = self.by_space[space].pop()
        if not self.by_space[space]:
            self.some &= ~(1 << space)
        self.open -= 1
        return found

    def rest(self) -> list[tuple[int, int]]:
        """The open bins with their free space."""
        return [(b, space) for space, bins in enumerate(self.by_space) for b in bins]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and ``ids`` (array<int>) if wanted.

    A document is the ids of its whole text and ``end``; a null or empty text is ``end`` alone.
    Only documents of more than ``capacity`` ids are cut; the first piece takes the remainder.
    Repeated rows and null doc_ids give pieces like any other row. Other columns are not read.
    """
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(split(batches)):
            ids, at = encode.ids(batch.column("cut"), end)
            out: list[list] = [[] for _ in range(5)]
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = ids[at[i]: at[i + 1]]
                stops = [*range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                for n, stop in enumerate(stops):
                    start = stops[n - 1] if n else 0
                    for column, value in zip(out, (doc, n, start, stop - start, crc(own[start:stop]))):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(out, types)]
            if with_ids:  # the pieces of a batch are its ids one after another
                stops = np.cumsum([0, *out[3]]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(stops, ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), cut(F.col("text"), tokenizer).alias("cut"))
    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset. Every piece has a ``length`` of 1 to ``capacity``.

    Offsets in a sequence start at 0 and have no gaps. Which sequence a piece gets does not depend
    on retries: pieces are numbered once, in writing, and dealt and ordered by a hash of the number. Rows of any document, however many it
    has, spread over all tasks. An empty table gives an empty result.
    """
    rows = durable(pieces.withColumn("_at", F.monotonically_increasing_id()))
    parts = rows.select("_at", "length").repartition("_at").sortWithinPartitions(F.xxhash64("_at"))
    # A level packs pieces into bins; the bins it leaves open are the pieces of the next level.
    placed = durable(parts.mapInArrow(_packer(capacity, open_bins, 0), _PLACED))
    steps, level = [placed.where("not is_bin")], 0
    bins = placed.where("is_bin")
    while True:
        tasks = bins.agg(F.count_distinct("task")).first()[0]
        if tasks <= 1:
            break
        level += 1
        wide = -(-tasks // _FAN_IN)
        group = F.pmod(F.xxhash64("task"), F.lit(wide))
        again = bins.select(F.col("sequence_id").alias("_at"), F.col("length"), group.alias("task"))
        again = again.repartition(wide, "task").sortWithinPartitions("_at")
        placed = durable(again.mapInArrow(_packer(capacity, open_bins, level), _PLACED))
        steps.append(placed.where("not is_bin"))
        bins = placed.where("is_bin")
    found = steps[0].select("_at", "sequence_id", "offset")
    for moved in steps[1:]:  # a bin that was packed again takes its pieces with it
        to = moved.select(F.col("_at").alias("sequence_id"), F.col("sequence_id").alias("to"), F.col("offset").alias("more"))
        found = found.join(to, "sequence_id", "left").select(
            "_at", F.coalesce("to", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"),
        )
    return rows.join(found, "_at").drop("_at")


_PLACED = "_at long, task long, length long, sequence_id long, offset long, is_bin boolean"


def _packer(capacity: int, open_bins: int, level: int):
    """Rows of one task: every piece with its bin, then the bins left open, as pieces of their used length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first = (level << 58) | (task << 34)
        bins, new = Bins(capacity, open_bins), first
        for batch in batches:
            # Within a batch the long pieces go first; over the batches arrival is at random.
            order = np.argsort(-batch.column("length").to_numpy(zero_copy_only=False), kind="stable")
            batch = batch.take(pa.array(order))
            lengths = batch.column("length").to_pylist()
            seq, offset = [], []
            for n in lengths:
                b, o, _ = bins.place(n, new)
                new += b == new
                seq.append(b)
                offset.append(o)
            yield _rows(batch.column("_at"), task, lengths, seq, offset, False)
        rest = bins.rest()
        if rest:
            yield _rows(pa.nulls(len(rest), pa.int64()), task, [capacity - s for _, s in rest],
                        [b for b, _ in rest], [0] * len(rest), True)

    return run


def _rows(at: pa.Array, task: int, lengths: list, seq: list, offset: list, is_bin: bool) -> pa.RecordBatch:
    n = len(seq)
    return pa.RecordBatch.from_arrays(
        [at, pa.array(np.full(n, task), pa.int64()), pa.array(lengths, pa.int64()), pa.array(seq, pa.int64()),
         pa.array(offset, pa.int64()), pa.array(np.full(n, is_bin))],
        names=["_at", "task", "length", "sequence_id", "offset", "is_bin"],
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of every sequence, from packed pieces with their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids together
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids")
    )
