"""Repeated passages removed with an FM-index per shard.

A passage is a window of 20 words. Every window has an anchor, the six-word run in it with the
smallest hash, so equal windows have equal anchors wherever they stand. Windows with an anchor that
different texts share go, as segments of neighbouring windows, to the shard of that anchor. There the
segments are indexed and streamed through the index by backward search over a wavelet matrix; a
window that also begins earlier is reported and its words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circdesk.llm.fm_index import repeats_before
from circdesk.llm.support import durable, pieces
from circdesk.llm.words import run_hashes, word_hashes

WINDOW = 20
_ANCHOR = 6
_WORD = 5  # bytes of a word's hash in a segment
_ROWS = 500
_SHARD_WORDS = 200_000
_MOST = 5000  # segments of one anchor that are indexed together


def without_repeats(docs: DataFrame, window: int = WINDOW, most: int = _MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space).

    A word is removed when a window that covers it has the same words as one that starts earlier: in
    a smaller doc_id, or in the same document before it. Windows are judged on the input. Null and empty
    texts and texts shorter than a window lose nothing. Rows with a null doc_id have no place in the
    order and keep all their words; repeated rows (same doc_id and text) get the same answer. An
    empty table gives an empty result. Only doc_id and text are read.

    Of texts with the same words only the first is examined; the others lose every word. An anchor with
    more than ``most`` different segments, as at the edges of a passage that very many documents
    share, is not indexed in one task: its windows are grouped one by one instead, with the same result.
    """
    scanned = durable(_scanned(docs, window))
    firsts = durable(scanned.where("doc_id is not null").groupBy("words_id").agg(F.min("doc_id").alias("first_id")))
    anchors = scanned.where("doc_id is not null").select("doc_id", "words_id", "anchors", "inner")
    met = anchors.select(F.explode("anchors").alias("anchor"), F.xxhash64("words_id").alias("w"))
    shared = met.groupBy("anchor").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a <> b").select("anchor")
    shared = durable(shared.unionByName(anchors.select(F.explode("inner").alias("anchor"))).distinct())
    where = anchors.select("doc_id", "words_id", F.explode("anchors").alias("anchor")).join(shared, "anchor")
    wanted = durable(
        where.groupBy("doc_id", "words_id").agg(F.collect_set("anchor").alias("anchors"))
        .join(firsts.select("words_id", F.col("first_id").alias("doc_id")), ["words_id", "doc_id"])
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    texts = durable(texts.dropDuplicates(["doc_id", "words_id"]))
    segments = durable(
        texts.mapInArrow(_segments(window, True), _SEGMENT + ", words binary").groupBy("anchor", "segment_id").agg(
            F.min(F.struct("doc_id", "start")).alias("first"), F.first("words").alias("words"),
            F.count(F.lit(1)).alias("n")).select("anchor", "segment_id", "first.*", "words", "n")
    )
    crowded = durable(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > most).select("anchor"))
    marked = _indexed(segments.join(crowded, "anchor", "left_anti"), window).unionByName(
        _grouped(segments.join(crowded, "anchor", "left_semi"), window))
    marks = marked.groupBy("segment_id").agg(F.bit_or("mask").alias("mask"))
    known = durable(
        segments.where("n > 1").select("segment_id", "doc_id", "start", "n").join(marks, "segment_id", "full_outer")
        .select("segment_id", F.struct(F.col("doc_id"), F.col("start")).alias("first"), F.coalesce("n", F.lit(1)).alias("n"),
                F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))
    )
    places = texts.mapInArrow(_segments(window, False), _SEGMENT).join(known, "segment_id")
    later = (F.col("n") > 1) & (F.struct("doc_id", "start") != F.col("first"))
    hits = places.select(
        "doc_id", "words_id", "start", F.when(later, F.lit(-1)).otherwise(F.col("mask")).alias("mask"), "windows"
    ).where("mask <> 0")
    hits = hits.groupBy("doc_id", "words_id").agg(F.collect_list(F.struct("start", "mask", "windows")).alias("hits"))
    cut = durable(texts.select("doc_id", "words_id", "text").join(hits, ["doc_id", "words_id"]).mapInArrow(
        _remaining(window), "doc_id long, words_id binary, n_removed long, kept_sha256 string"))
    rows = scanned.select("doc_id", "words_id", "n_words", "all_sha256").join(firsts, "words_id", "left").join(
        cut, ["doc_id", "words_id"], "left")
    copy = (F.col("n_words") >= window) & F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def _anchored(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each run of windows with one anchor."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    hashes = run_hashes(words, _ANCHOR)
    width = window - _ANCHOR + 1
    place = np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(1) + np.arange(len(words) - window + 1)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return hashes[place[start]], start, np.diff(np.append(start, len(place)))


def _scanned(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                words = word_hashes(text)
                anchors, counts = np.unique(_anchored(words, window)[0], return_counts=True)
                row = (xxhash.xxh3_128_digest(words.tobytes()), len(words), _sha(_split(text)),
                       anchors.view(np.int64), anchors[counts > 1].view(np.int64))
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, types)]],
                names=["doc_id", "words_id", "n_words", "all_sha256", "anchors", "inner"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, words_id binary, n_words long, all_sha256 string, anchors array<long>, inner array<long>")


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_SEGMENT = "doc_id long, words_id binary, anchor long, segment_id binary, start int, windows int"


def _segments(window: int, with_words: bool):
    """The segments of a text at its wanted anchors; equal words give an equal segment_id."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS // 5):
            docs, out = [], [[], [], [], [], []]
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("anchors"))):
                words = word_hashes(text)
                anchors, starts, counts = _anchored(words, window)
                use = np.isin(anchors.view(np.int64), np.asarray(wanted.values))
                data = (words >> np.uint64(64 - 8 * _WORD)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WORD].tobytes()
                for a, s, n in zip(anchors.view(np.int64)[use].tolist(), starts[use].tolist(), counts[use].tolist()):
                    part = data[s * _WORD: (s + n + window - 1) * _WORD]
                    docs.append(i)
                    for column, value in zip(out, (a, xxhash.xxh3_128_digest(part), s, n, part if with_words else None)):
                        column.append(value)
            at = pa.array(docs, pa.int32())
            columns = [batch.column("doc_id").take(at), batch.column("words_id").take(at), pa.array(out[0], pa.int64()),
                       pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())]
            names = [c.split()[0] for c in _SEGMENT.split(", ")]
            if with_words:
                columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "words"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _indexed(segments: DataFrame, window: int) -> DataFrame:
    """segment_id and mask (bit i: window i also begins earlier) of segments, by one index per shard."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in pieces(batches, 2000):
            rows = pa.Table.from_batches([batch])
            held.append(rows)
            size += rows.column("words").nbytes // _WORD
            if size >= _SHARD_WORDS:  # a shard ends between two anchors
                rows = pa.concat_tables(held).combine_chunks()
                anchor = rows.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1], "left"))
                if cut:
                    yield _searched(rows.slice(0, cut), window)
                    held = [rows.slice(cut)]
                    size = held[0].column("words").nbytes // _WORD
        if held:
            yield _searched(pa.concat_tables(held).combine_chunks(), window)

    columns = segments.select("anchor", "segment_id", "doc_id", "start", "words")
    return columns.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "segment_id binary, mask long")


def _searched(rows: pa.Table, window: int) -> pa.RecordBatch:
    parts = rows.column("words").to_pylist()
    sizes = np.array([len(p) // _WORD for p in parts], np.int64)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :_WORD] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, _WORD)
    _, symbols = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    segments = np.split(symbols.astype(np.int64) + 1, np.cumsum(sizes)[:-1])
    windows = sizes - window + 1
    doc = np.repeat(rows.column("doc_id").to_numpy(), windows)
    ends = np.cumsum(windows)
    inside = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
    place = np.repeat(rows.column("start").to_numpy(), windows) + inside
    order = np.lexsort((place, doc))
    key = np.empty(len(order), np.int64)
    key[order] = np.arange(len(order))
    found = repeats_before(segments, np.split(key, ends[:-1]), window)
    mask = [int(sum(1 << int(i) for i in np.flatnonzero(f))) for f in found]
    hit = np.array(mask) != 0
    return pa.RecordBatch.from_arrays(
        [rows.column("segment_id").combine_chunks().filter(pa.array(hit)), pa.array([m for m in mask if m], pa.int64())],
        names=["segment_id", "mask"])


def _grouped(segments: DataFrame, window: int) -> DataFrame:
    """The same for segments of crowded anchors, window by window; minima are combined before the shuffle."""
    count = F.expr(f"cast(length(words) / {_WORD} as int) - {window}")
    single = durable(
        segments.select("segment_id", "doc_id", "start", "words", F.explode(F.sequence(F.lit(0), count)).alias("i")).select(
            "segment_id", "i", F.struct("doc_id", (F.col("start") + F.col("i")).alias("start")).alias("place"),
            F.md5(F.substring("words", F.col("i") * _WORD + 1, F.lit(window * _WORD))).alias("window"))
    )
    least = durable(single.groupBy("window").agg(F.min("place").alias("least")))
    return single.join(least, "window").where("place > least").select("segment_id", F.expr("shiftleft(1L, i)").alias("mask"))


def _remaining(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            removed, shas = [], []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                words = _split(text)
                edge = np.zeros(len(words) + 1, np.int64)
                for h in hits:
                    mask = h["mask"]
                    for i in range(h["windows"]):
                        if mask >> i & 1:
                            edge[h["start"] + i] += 1
                            edge[h["start"] + i + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                shas.append(_sha([w for w, g in zip(words, gone) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("words_id"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "words_id", "n_removed", "kept_sha256"])

    return run
