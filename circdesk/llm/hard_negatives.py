"""Hard negatives for anchors, by threshold joins on inverted indexes.

Vectors of integers are cut into blocks of rows at random; a cell is one block of rows beside one
block of anchors. In a cell the rows are indexed by dimension, largest dimensions first, and the
trailing dimensions of a row stay out of the index while their norm alone cannot reach the
threshold of any anchor there. Partial scores are accumulated over the posting lists and a pair is
pruned when its score so far plus the product of the remaining norms is too low; what stays is
scored in full. Thresholds start high and are lowered until the windows of an anchor are full.

Blocks of rows are taken in slices that grow eightfold. The best rows found so far give the lowest
threshold that still matters in the next slice, so late slices return few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from circdesk.llm.support import durable

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # a negative's score in percent of the positive's
SCALE = 256
ANCHOR_EVERY = 100
ROWS_PER_BLOCK = 8192
ANCHORS_PER_BLOCK = 2048
_GROWTH = 8
_LOWER = 0.8
_STEP = 8  # dimensions accumulated between two prunings
_CHUNK = 256  # anchors scored together
_PAIRS = 1 << 16  # pairs scored in full together
_EXACT = float(1 << 53)


def labelled_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and ``v`` (integers floor(256 * x)) of the rows that take part."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"),
        F.transform(values, lambda x: F.floor(x * F.lit(float(SCALE))).cast("long")).alias("v"),
    )


def hard_negatives(
    vectors: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, anchors_per_block: int = ANCHORS_PER_BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Of
    vectors of different lengths the shorter one counts as ending in zeros; an empty vector scores 0 with
    everything. Rows with the anchor's vec_id are neither its positives nor its negatives. Otherwise
    rows that repeat a vec_id stand for themselves, and an anchor that repeats one gives its rows as
    often; ties go by vec_id, so they may only differ in which of several equal ids is meant.
    An anchor without other rows of its label, a positive of negative score and a
    window without rows give nothing, and so does an empty table. Other columns are not read. Scores
    beyond 64 bits raise an error.
    """
    rows, seen = durable(
        labelled_vectors(vectors).withColumn("_u", F.rand(3)),
        n=F.count(F.lit(1)), anchors=F.count_if(F.col("vec_id") % ANCHOR_EVERY == 0),
    )
    blocks = max(1, -(-seen["n"] // rows_per_block))
    groups = max(1, -(-seen["anchors"] // anchors_per_block))
    # The numbers of blocks come from counted rows and the places from a stored draw, so reruns of a task agree.
    cells = _Cells(
        rows.withColumn("block", (F.col("_u") * blocks).cast("int")).drop("_u"),
        durable(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).select(
            F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v",
            (F.col("_u") * groups).cast("int").alias("group"))),
        blocks, groups,
    )
    anything = F.lit(None).cast("long")
    positive = cells.best(
        cells.anchors.select("anchor", F.lit(0).alias("slot"), anything.alias("low"), anything.alias("high")), True, POSITIVES)
    windows = positive.where("score >= 0").select(
        "anchor", F.col("rank").alias("slot"),
        # 30 p <= 100 n <= 90 p, in whole numbers
        F.expr(f"({LOW} * score + 99) div 100").alias("low"), F.expr(f"{HIGH} * score div 100").alias("high"),
    )
    negative = cells.best(windows, False, NEGATIVES)
    ids = cells.anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    pairs = positive.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"),
                            F.col("score").alias("positive_score")).join(ids, "anchor")
    return negative.join(pairs, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


_FOUND = "anchor long, slot int, vec_id long, score long"


@dataclass(frozen=True)
class _Cells:
    rows: DataFrame  # vec_id, label, v, block
    anchors: DataFrame  # anchor, vec_id, label, v, group
    blocks: int
    groups: int

    def best(self, windows: DataFrame, same: bool, wanted: int) -> DataFrame:
        """The first ``wanted`` rows of every window (anchor, slot), with their rank.

        A window holds the rows of the anchor's label (``same``) or of other labels whose scores lie
        from ``low`` to ``high``; null is open. Every row is looked at in exactly one slice.
        """
        windows = durable(windows)
        place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
        found, start, wide = None, 0, 1
        while start < self.blocks:
            stop = min(self.blocks, start + wide)
            floor = windows.withColumn("least", F.col("low"))
            if found is not None:  # a full window is only entered at its last score or above
                full = found.where(F.col("rank") == wanted).select("anchor", "slot", F.col("score").alias("last"))
                floor = windows.join(full, ["anchor", "slot"], "left").withColumn("least", F.greatest("low", "last")).drop("last")
            now = self._slice(floor, start, stop, same, wanted)
            if found is not None:
                now = now.unionByName(found.drop("rank"))
            found = durable(now.withColumn("rank", place).where(F.col("rank") <= wanted))
            start, wide = stop, wide * _GROWTH
        return found

    def _slice(self, windows: DataFrame, start: int, stop: int, same: bool, wanted: int) -> DataFrame:
        """Every cell's own first rows of each window: rows of the blocks from ``start`` to ``stop``."""
        # ``slots`` gathers an anchor's windows, five at most
        asked = windows.groupBy("anchor").agg(F.collect_list(F.struct("slot", "least", "high")).alias("slots"))
        anchors = self.anchors.join(asked, "anchor").withColumn("block", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
        rows = self.rows.where(F.col("block").between(start, stop - 1)).withColumn(
            "group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        run = _cell(same, wanted)
        return rows.groupBy("block", "group").cogroup(anchors.groupBy("block", "group")).applyInArrow(run, _FOUND)


def _cell(same: bool, wanted: int):
    names = [c.split()[0] for c in _FOUND.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            out = [x for part in _search(rows, anchors, same, wanted) for x in part]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, types)], names=names)

    return run


def _search(rows: pa.Table, anchors: pa.Table, same: bool, wanted: int) -> Iterator[list[tuple]]:
    wide = max(int(c.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for c in (rows["v"], anchors["v"]))
    index = Index(_matrix(rows["v"], wide), _matrix(anchors["v"], wide))
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    mark = {n: anchors[n].to_numpy() for n in ("anchor", "vec_id", "label")}
    slots = anchors["slots"].to_pylist()
    for start in range(0, len(slots), _CHUNK):
        part = np.arange(start, min(start + _CHUNK, len(slots)))
        open_ = part
        lowest = np.array([min(-np.inf if s["least"] is None else s["least"] for s in slots[i]) for i in part], float)
        highest = np.array([max(np.inf if s["high"] is None else s["high"] for s in slots[i]) for i in part], float)
        threshold = np.maximum(lowest, np.minimum(highest, index.most(part)))
        while len(open_):
            a, r, score = index.above(open_, threshold)
            fits = (labels[r] == mark["label"][open_[a]]) == same
            fits &= ids[r] != mark["vec_id"][open_[a]]
            a, r, score = a[fits], r[fits], score[fits]
            order = np.lexsort((ids[r], -score, a))
            a, r, score = a[order], r[order], score[order]
            ends = np.searchsorted(a, np.arange(len(open_) + 1))
            again = np.zeros(len(open_), bool)
            for i, at in enumerate(open_):
                own, scores = r[ends[i]: ends[i + 1]], score[ends[i]: ends[i + 1]]
                done = threshold[i] <= lowest[i]
                windows = []
                for s in slots[at]:  # scores fall, so a window is a run of them
                    first = 0 if s["high"] is None else int(np.searchsorted(-scores, -s["high"]))
                    last = len(scores) if s["least"] is None else int(np.searchsorted(-scores, -s["least"], "right"))
                    last = min(last, first + wanted)
                    full = last - first == wanted or s["least"] is not None and threshold[i] <= s["least"]
                    again[i] |= not (full or done)
                    windows.append((s["slot"], first, last))
                if not again[i]:
                    yield [(int(mark["anchor"][at]), slot, int(ids[own[j]]), int(scores[j]))
                           for slot, first, last in windows for j in range(first, last)]
            open_, lowest = open_[again], lowest[again]
            threshold = np.maximum(lowest, _lower(threshold[again], index.norm(open_)))


def _lower(threshold: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A fifth lower; a threshold of next to nothing goes to none at all."""
    return np.where(threshold > 0.02 * norm, threshold * _LOWER, -np.inf)


def _matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """The vectors as rows, short ones ending in zeros."""
    values = column.combine_chunks()
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    return out


class Index:
    """Rows by dimension, and the anchors that search them.

    Dimensions are ordered by what they add to the norms, so that the trailing ones are small. The
    rows are sorted by how many leading dimensions of theirs are indexed, most first: the posting list
    of a dimension is then a run of rows from the first on.
    """

    def __init__(self, rows: np.ndarray, anchors: np.ndarray) -> None:
        # Each component as a double before squaring: bounds need no exact squares
        energy = (rows.astype(float) ** 2).sum(0)
        self.order = np.argsort(-energy, kind="stable")
        self.rows, self.anchors = rows[:, self.order], anchors[:, self.order]
        self.row_rest, self.anchor_rest = _rests(self.rows), _rests(self.anchors)
        largest = float(self.row_rest[:, 0].max(initial=0) * self.anchor_rest[:, 0].max(initial=0))
        if largest >= 2.0**63:
            raise ValueError("scores don't fit in 64 bits")
        if largest < _EXACT:  # every partial sum is a whole number that a double holds
            self.rows, self.anchors = self.rows.astype(float), self.anchors.astype(float)

    def most(self, anchors: np.ndarray) -> np.ndarray:
        """The most that an anchor could score here."""
        return self.anchor_rest[anchors, 0] * self.row_rest[:, 0].max(initial=0)

    def norm(self, anchors: np.ndarray) -> np.ndarray:
        return self.most(anchors)

    def above(self, anchors: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``anchors``, row, score) of all pairs that score the anchor's threshold or more."""
        own, own_rest = self.anchors[anchors], self.anchor_rest[anchors]
        least = float((threshold / np.maximum(own_rest[:, 0], 1e-9)).min(initial=np.inf))
        dims = self.rows.shape[1]
        # The leading dimensions that must be indexed: after them a row's rest is below every threshold.
        indexed = (self.row_rest >= least).sum(1) if least > 0 else np.full(len(self.rows), dims)
        indexed = np.minimum(dims, -(-np.minimum(indexed, dims) // _STEP) * _STEP)
        by = np.argsort(-indexed, kind="stable")
        by = by[: int((indexed > 0).sum())] if least > 0 else by
        rows, rest, indexed = self.rows[by], self.row_rest[by], indexed[by]
        sums = np.zeros((len(anchors), len(by)), rows.dtype)
        alive = np.ones(sums.shape, bool)
        for a in range(0, dims, _STEP):
            b = min(dims, a + _STEP)
            n = int(np.searchsorted(-indexed, -a, "left"))  # rows with more than ``a`` dimensions indexed
            if not n:
                break
            sums[:, :n] += own[:, a:b] @ rows[:n, a:b].T
            alive[:, :n] &= sums[:, :n] + own_rest[:, b, None] * rest[None, :n, b] >= threshold[:, None]
            if alive.mean() < 0.02:
                break
        row, col = np.nonzero(alive)
        out = [(row[:0], col[:0], np.zeros(0, np.int64))]
        for i in range(0, len(row), _PAIRS):
            r, c = row[i: i + _PAIRS], col[i: i + _PAIRS]
            score = np.einsum("ij,ij->i", own[r], rows[c]).astype(np.int64)
            fits = score >= threshold[r]
            out.append((r[fits], by[c[fits]], score[fits]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _rests(vectors: np.ndarray) -> np.ndarray:
    """Norm of the dimensions from each place on, a little enlarged against rounding."""
    squares = np.zeros((len(vectors), vectors.shape[1] + 1))
    squares[:, :-1] = np.cumsum((vectors.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(squares) * (1 + 1e-9)
