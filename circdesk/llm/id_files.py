"""Token ids in binary shard files with keyed access.

A shard holds the ids of a range of documents, in ascending doc_id order, as raw little-endian
unsigned 16-bit integers (``.ids``), and beside it an index (``.idx``): a minimal perfect hash maps
a key to its slot, the slot holds a fingerprint of the key and the rows it stands for, and the row
its offset in the raw ids. A look-up takes the same few reads whatever the size of the shard.

Index layout, all little-endian 64-bit unless noted: counts (keys, rows, null keys, levels, keys
left over); bits per level; the bit words of all levels; ones before each word; left-over hashes;
fingerprint, first row and row count per slot (32-bit each); doc_id per row; offsets (rows + 1).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circdesk.llm.support import durable
from circdesk.llm.tokens import crc, cut, encoder, slices, split
from circdesk.operators.scratch import scratch_folder

_SPARE = 2.0
_LEVELS = 40
_ODD = 0x9E3779B97F4A7C15


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((seed * 2 + 1) * _ODD % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: every level settles the keys that are alone on a bit."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, left: np.ndarray) -> None:
        self.sizes, self.words, self.left = sizes, words, left
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        left = np.sort(keys.astype(np.uint64))
        for level in range(_LEVELS):
            if not len(left):
                break
            size = -(-int(_SPARE * len(left) + 1) // 64) * 64
            bit = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(bit, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[bit]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"), left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; for a key that was not built in, some slot or -1."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, place = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> place) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << place) - np.uint64(1)))
            out[open_[hit]] = (self.before[word] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        place = np.searchsorted(self.left, keys[open_])
        same = np.append(self.left, np.uint64(0))[place] == keys[open_]
        out[open_] = np.where(same & (place < len(self.left)), self.before[-1] + place, -1)
        return out


class Index:
    """One shard's index: built from its rows, or read back."""

    def __init__(self, doc_ids: np.ndarray, offsets: np.ndarray, nulls: int, table: PerfectHash | None = None,
                 slots: np.ndarray | None = None) -> None:
        self.doc_ids, self.offsets, self.nulls = doc_ids, offsets, nulls
        if table is None:
            keys, first, count = np.unique(doc_ids[nulls:], return_index=True, return_counts=True)
            keys = keys.view(np.uint64)
            table = PerfectHash.build(keys)
            slots = np.zeros((len(keys), 3), "<u4")
            slots[table.slots(keys)] = np.stack([_fingerprint(keys), first + nulls, count], 1)
        self.table, self.slots = table, slots

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; no rows where the fingerprint differs."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.table.slots(keys)
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        entry = self.slots[slot]
        known = (slot >= 0) & (entry[:, 0] == _fingerprint(keys))
        return entry[:, 1].astype(np.int64), np.where(known, entry[:, 2], 0).astype(np.int64)

    def to_bytes(self) -> bytes:
        t = self.table
        head = [len(self.slots), len(self.doc_ids), self.nulls, len(t.sizes), len(t.left)]
        parts = [(head, "<i8"), (t.sizes, "<i8"), (t.words, "<u8"), (t.before, "<i8"), (t.left, "<u8"),
                 (self.slots, "<u4"), (self.doc_ids, "<i8"), (self.offsets, "<i8")]
        return b"".join(np.asarray(a).astype(kind).tobytes() for a, kind in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        at = 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        keys, rows, nulls, levels, left = take(5, "<i8").tolist()
        sizes = take(levels, "<i8")
        words = take(int(sizes.sum()) // 64, "<u8")
        take(len(words) + 1, "<i8")
        table = PerfectHash(sizes, words, take(left, "<u8"))
        slots = take(3 * keys, "<u4").reshape(-1, 3)
        return cls(take(rows, "<i8"), take(rows + 1, "<i8"), nulls, table, slots)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


_SHARD = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long"


def write_ids(docs: DataFrame, tokenizer: str, end: int = 2, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents and return the list of shards: shard, path without its ending,
    n_docs, n_ids, first_id and last_id (null without keys), start (ids in all earlier shards).

    Texts are encoded whole, null as empty, with ``end`` after each. Null doc_ids come first and
    have no key; rows with the same doc_id lie next to each other and share a key, and if they are too
    many for one shard they go over several. ``folder`` must be one that all executors can reach; the
    default is under the session's checkpoint folder. A task that is tried again writes files with
    new names, and the list names those of the attempt that counted. No documents, no shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        encode, ids_of, at, out = encoder(tokenizer), [], [np.zeros(1, np.int64)], None
        for batch in slices(split(batches)):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{path}.ids")
            ids, stops = encode.ids(batch.column("cut"), end)
            out.write(ids.astype("<u2").tobytes())
            at.append(stops[1:] + at[-1][-1])
            ids_of.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        doc_ids = pa.chunked_array(ids_of)
        keys = doc_ids.fill_null(0).to_numpy()
        index = Index(keys, np.concatenate(at), doc_ids.null_count)
        with store.open_output_stream(f"{path}.idx") as side:
            side.write(index.to_bytes())
        ends = [int(keys[index.nulls]), int(keys[-1])] if index.nulls < len(keys) else [None, None]
        name = path[len(root):].lstrip("/")
        row = [shard, f"{folder}/{name}", len(keys), int(index.offsets[-1]), *ends]
        types = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                         names=[c.split()[0] for c in _SHARD.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = durable(rows.select("doc_id", cut(F.col("text"), tokenizer).alias("cut")).mapInArrow(run, _SHARD))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32 of every document, and ``ids``
    (array<int>) if wanted, read from the files through the index."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, ids = _open(row["path"])
                n = len(index.doc_ids)
                first, count = index.rows(index.doc_ids[index.nulls:])
                own = np.arange(index.nulls, n)
                if not ((first <= own) & (own < first + count)).all():
                    raise ValueError(f"the index of {row['path']} does not match its rows")
                for low in range(0, n, 2000):
                    at = index.offsets[low: low + 2001]
                    block = ids(at[0], at[-1])
                    texts = [block[a - at[0]: b - at[0]] for a, b in zip(at[:-1], at[1:])]
                    keys = pa.array(index.doc_ids[low: low + 2000], pa.int64(),
                                    mask=np.arange(low, low + len(texts)) < index.nulls)
                    out = [keys, pa.array(row["start"] + at[:-1]), pa.array(np.diff(at)),
                           pa.array([crc(t) for t in texts], pa.int64())]
                    if with_ids:
                        out.append(pa.array([t.tolist() for t in texts], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    # A number of its own keeps the few short rows from being put into one task.
    return shards.select("path", "start").repartition(max(1, shards.count()), "path").mapInArrow(run, schema)


def look_up(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and ids of the asked documents, one row per stored row; unknown and null keys give none.

    ``keys`` has doc_id. A key is routed by the shards' id ranges (one pair per shard is sent to the
    tasks) and then takes one hash, one fingerprint and one read of its ids.
    """
    ranges = [(r.first_id, r.last_id, r.path) for r in
              shards.where("first_id is not null").orderBy("shard").select("first_id", "last_id", "path").collect()]
    low = np.array([r[0] for r in ranges], np.int64)
    high = np.array([r[1] for r in ranges], np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("doc_id").to_numpy()
            doc, found = [], []
            from_, to = np.searchsorted(high, asked, "left"), np.searchsorted(low, asked, "right")
            for shard in np.unique(np.concatenate([np.arange(a, b) for a, b in zip(from_, to)] or [low[:0]])).tolist():
                index, ids = _open(ranges[shard][2])
                own = asked[(from_ <= shard) & (shard < to)]
                for key, first, count in zip(own.tolist(), *index.rows(own)):
                    for row in range(first, first + count):
                        doc.append(key)
                        found.append(ids(index.offsets[row], index.offsets[row + 1]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return wanted.repartitionByRange("doc_id").mapInArrow(run, "doc_id long, ids array<int>")


@functools.lru_cache(maxsize=4)
def _open(path: str):
    """The index of a shard, and a function that reads ids from place to place."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}.idx") as side:
        index = Index.from_bytes(side.read())
    raw = store.open_input_file(f"{root}.ids")
    return index, lambda a, b: np.frombuffer(raw.read_at(2 * int(b - a), 2 * int(a)), "<u2")
