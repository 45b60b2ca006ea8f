"""Near-duplicate embeddings by NN-descent.

A neighbour graph is seeded from sorted sign signatures and refined by comparing the neighbours of
each vector with one another, until hardly any link above the threshold is new. A vector whose
whole list lies above the threshold may have more such neighbours: its list is enlarged to all of
its component, compared in blocks, and to the vectors of other components that lie near the middle of
the full lists' owners in it, which are all that can be similar to one of them. An audit against brute force on a
sample decides whether the graph is good enough, else more seeds are added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from circdesk.llm.support import components, durable, pieces, roots

THRESHOLD = 0.98
NEIGHBOURS = 8
TREES = 4
RECALL = 0.995
_AUDITED = 300
_WINDOW = 64
_BLOCK = 256
_SIDE = 2000
_ROUNDS = 8
_ROWS = 4000
_EDGE = "v long, u long, sim double"


def linked_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors with equal labels and a cosine (in double precision) of at least ``threshold`` are
    linked; vectors of different lengths are not. A vector that is null, zero or has null or
    non-finite components, or whose label or vec_id is null, has no links; it is its own component
    (a null vec_id has a null one and is not kept). Equal vectors are compared once and count with
    their number; of repeated rows with one vec_id each counts as a vector. An empty table gives
    an empty result. Only vec_id, label and embedding are read.

    All comparisons are between rows that Spark brings together in groups of bounded size: windows
    of a sorted range, neighbours of one vector (popular ones in several groups), pairs of blocks of
    a component, blocks of vectors and of middles of components with full lists.
    """
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    usable = source.where(_usable())
    points = durable(
        usable.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("pid", F.monotonically_increasing_id())
    )
    unit = durable(points.select("pid", "label", "vector", "copies").mapInArrow(
        _unit, f"pid long, label {dict(points.dtypes)['label']}, size int, vector binary, copies long"))
    graph = unit.limit(0).select(F.col("pid").alias("v"), F.col("pid").alias("u"), F.lit(0.0).alias("sim"))
    for attempt in range(4):
        graph = durable(_nearest(graph.unionByName(_seeds(unit, trees, attempt, neighbours)), neighbours))
        for _ in range(_ROUNDS):
            graph, fresh, near = _refined(graph, unit, neighbours, threshold)
            if fresh <= 0.001 * near:
                break
        links = graph.where(F.col("sim") >= threshold - 1e-6)
        parts = durable(components(links, "v", "u").withColumnRenamed("node", "pid"))
        full = durable(links.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= neighbours).select(F.col("v").alias("pid")))
        if not full.isEmpty():
            across = durable(_across(full, parts, unit, threshold))
            if not across.isEmpty():
                links = links.select("v", "u").unionByName(across)
                parts = durable(components(links, "v", "u").withColumnRenamed("node", "pid"))
        counts = durable(_counted(parts, unit, threshold))
        if _audited(unit, counts, threshold) >= recall:
            break
    # A component of the graph may hold pairs below the threshold only; real links decide.
    real = components(counts.where("root <> pid"), "pid", "root").withColumnRenamed("node", "pid")
    total = counts.groupBy("pid").agg(F.sum("links").alias("links"))
    named = points.select("pid", "vec_id").join(real, "pid")
    lowest = durable(named.groupBy("component_id").agg(F.min("vec_id").alias("lowest")))
    found = durable(
        points.join(total, "pid", "left").join(named.join(lowest, "component_id").select("pid", "lowest"), "pid", "left")
        .select("label", "vector", "copies", "links", F.coalesce("lowest", "vec_id").alias("component_id"))
    )
    keyed = source.withColumn("usable", F.coalesce(_usable(), F.lit(False)))
    inside = keyed.where("usable").join(found, ["label", "vector"]).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    outside = keyed.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def _usable() -> Column:
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~odd & some


def _unit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.asarray(v, np.float64) for v in batch.column("vector").to_pylist()]
        # Scaled first, so that very large and very small components neither overflow nor vanish.
        rows = [v / np.abs(v).max() for v in rows]
        out = [(v / np.sqrt((v * v).sum())).tobytes() for v in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("pid"), batch.column("label"), pa.array([len(v) for v in rows], pa.int32()),
             pa.array(out, pa.binary()), batch.column("copies")],
            names=["pid", "label", "size", "vector", "copies"])


def _seeds(unit: DataFrame, trees: int, attempt: int, k: int) -> DataFrame:
    """Neighbours inside overlapping windows of vectors sorted by the signs of random projections."""
    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            sizes = batch.column("size").to_numpy()
            marks = np.zeros((batch.num_rows, trees), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _matrix([batch.column("vector")[int(i)].as_buffer() for i in rows])
                for t in range(trees):
                    planes = np.random.default_rng([attempt, t, int(size)]).standard_normal((size, 32))
                    marks[rows, t] = (x @ planes > 0) @ (1 << np.arange(31, -1, -1))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("size"), pa.array(np.full(len(sizes), t), pa.int32()),
                     pa.array(marks[:, t]), batch.column("pid"), batch.column("vector")],
                    names=["label", "size", "tree", "mark", "pid", "vector"])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("tree", "label", "size"), _WINDOW, _WINDOW // 2):
            yield _best(rows, k, None)

    kind = dict(unit.dtypes)["label"]
    keys = ["tree", "label", "size", "mark", "pid"]
    marked = unit.select("pid", "label", "size", "vector").mapInArrow(
        signed, f"label {kind}, size int, tree int, mark long, pid long, vector binary")
    return marked.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(windows, _EDGE)


def _refined(graph: DataFrame, unit: DataFrame, k: int, threshold: float) -> tuple[DataFrame, int, int]:
    """One round: neighbours of a common neighbour are compared; also the new links above the threshold, and all."""
    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("hub",), 2 * _WINDOW, 0):
            yield _best(rows, k, "floor")

    worst = graph.groupBy("v").agg(F.min("sim").alias("floor"), F.count(F.lit(1)).alias("n"))
    worst = worst.select(F.col("v").alias("pid"), F.when(F.col("n") >= k, F.col("floor")).otherwise(-2.0).alias("floor"))
    carried = unit.select("pid", "vector").join(worst, "pid")
    members = graph.select(F.col("u").alias("hub"), F.col("v").alias("pid")).unionByName(
        graph.select(F.col("v").alias("hub"), F.col("u").alias("pid"))
    ).unionByName(carried.select(F.col("pid").alias("hub"), "pid")).distinct()
    local = members.join(carried, "pid").withColumn("place", F.xxhash64("hub", "pid"))
    new = local.repartition("hub").sortWithinPartitions("hub", "place").mapInArrow(compared, _EDGE)
    both = graph.withColumn("old", F.lit(1)).unionByName(new.withColumn("old", F.lit(0)))
    best = _nearest(both, k, "old")
    close = F.col("sim") >= threshold
    graph, seen = durable(best, fresh=F.count_if(close & (F.col("old") == 0)), near=F.count_if(close))
    return graph.drop("old"), seen["fresh"], seen["near"]


def _nearest(edges: DataFrame, k: int, *old: str) -> DataFrame:
    one = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"), *[F.max(c).alias(c) for c in old])
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.col("sim").desc(), "u"))
    return one.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], most: int, again: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, at most ``most`` together, ``again`` of them shared with the next."""
    held = None
    for batch in pieces(batches, _ROWS):
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        codes = np.stack([rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1).tolist(), rows.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            last = b == rows.num_rows
            while b - a > most:
                yield rows.slice(a, most)
                a += most - again
            if last:
                held = rows.slice(a).combine_chunks()
            else:
                yield rows.slice(a, b - a)
    if held is not None:
        yield held


def _matrix(buffers: list) -> np.ndarray:
    return np.frombuffer(b"".join(buffers), np.float64).reshape(len(buffers), -1)


def _best(rows: pa.Table, k: int, floor: str | None) -> pa.RecordBatch:
    """For every row its ``k`` most similar others, above its floor if it has one."""
    x = _matrix(rows.column("vector").to_pylist())
    pid = rows.column("pid").to_numpy()
    sim = x @ x.T
    np.fill_diagonal(sim, -3)
    if floor:
        sim = np.where(sim > rows.column(floor).to_numpy()[:, None], sim, -3)
    k = min(k, len(pid) - 1)
    if k < 1:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["v", "u", "sim"])
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sim, best, 1).ravel()
    use = value > -2
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(pid, k)[use]), pa.array(pid[best.ravel()][use]), pa.array(value[use])], names=["v", "u", "sim"])


def _across(full: DataFrame, parts: DataFrame, unit: DataFrame, threshold: float) -> DataFrame:
    """Links (v, u) of vectors with owners of full lists (pid) in other components.

    Angles add up at most: what is linked with an owner lies within the threshold's angle and that of the farthest
    owner from the middle, which is one of them. Such vectors are compared with all owners of the component.
    """
    owners = durable(full.join(parts, "pid").join(unit.select("pid", "label", "size", "vector"), "pid"))
    middles = durable(owners.groupBy("component_id").agg(F.min_by("vector", "pid").alias("middle")))

    def far(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            x, m = (np.frombuffer(b"".join(v), np.float64) for v in (batch.column(c).to_pylist() for c in ("vector", "middle")))
            starts = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())[:-1]]).astype(np.int64)
            angle = np.arccos(np.clip(np.add.reduceat(x * m, starts), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("component_id"), batch.column("label"), batch.column("size"), pa.array(angle)],
                                             names=["component_id", "label", "size", "angle"])

    kind = dict(unit.dtypes)["label"]
    reach = owners.join(middles, "component_id").select("component_id", "label", "size", "vector", "middle").mapInArrow(
        far, f"component_id long, label {kind}, size int, angle double").groupBy("component_id", "label", "size").agg(
        F.max("angle").alias("reach"))
    around = durable(reach.join(middles, "component_id").select(
        "label", "size", F.col("component_id").alias("pid"), "component_id", "reach", F.col("middle").alias("vector")))
    others = unit.select("pid", "label", "size", "vector").join(parts, "pid", "left").select(
        "label", "size", "pid", "component_id", F.lit(0.0).alias("reach"), "vector")

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side in _sided(batches, ("label", "size", "b1", "b2")):
            (x, y), (met, own) = [_matrix(t.column("vector").to_pylist()) for t in side], [t.column("component_id").to_pylist() for t in side]
            least = np.cos(np.minimum(np.pi, side[0].column("reach").to_numpy() + np.arccos(threshold) + 1e-6)) - 1e-9
            a, b = np.nonzero(x @ y.T >= least[:, None])
            apart = [n for n, (i, j) in enumerate(zip(a, b)) if met[i] != own[j]]
            pid = side[1].column("pid").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid[b[apart]], pa.int64()), pa.array([met[i] for i in a[apart]], pa.int64())], names=["pid", "component_id"])

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side in _sided(batches, ("component_id", "b1", "b2")):
            (x, y), (u, v) = [_matrix(t.column("vector").to_pylist()) for t in side], [t.column("pid").to_numpy() for t in side]
            sim = y @ x.T
            best = sim.argmax(1)
            some = sim.max(1) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(u[best[some]])], names=["v", "u"])

    asked = durable(_two_sides(around, others, ["label", "size"]).mapInArrow(near, "pid long, component_id long"))
    asking = asked.join(unit.select("pid", "vector"), "pid").select("component_id", "pid", "vector")
    return _two_sides(owners.select("component_id", "pid", "vector"), asking, ["component_id"]).mapInArrow(linked, "v long, u long")


def _two_sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key laid out so that every block of ``a`` meets every block of ``b``."""
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    sizes = durable(rows.groupBy(*keys).agg(*[
        F.ceil(F.count_if(F.col("side") == s) / _SIDE).cast("int").alias(f"n{s}") for s in (0, 1)]).where("n0 > 0 and n1 > 0"))
    first = F.col("side") == 0
    laid = (
        rows.join(sizes, keys)
        .withColumn("own", F.pmod(F.xxhash64("pid"), F.when(first, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("n1")).otherwise(F.col("n0")) - 1)))
        .withColumns({"b1": F.when(first, F.col("own")).otherwise(F.col("other")), "b2": F.when(first, F.col("other")).otherwise(F.col("own"))})
        .drop("own", "other", "n0", "n1")
    )
    return laid.repartition(*keys, "b1", "b2").sortWithinPartitions(*keys, "b1", "b2")


def _sided(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The two sides of each pair of blocks in which there are both."""
    for rows in _runs(batches, keys, 1 << 30, 0):
        side = rows.column("side").to_numpy()
        if 0 < side.sum() < len(side):
            yield rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))


def _counted(parts: DataFrame, unit: DataFrame, threshold: float) -> DataFrame:
    """pid, links (weighted by copies) and root (one pid for all that links connect here) from all pairs of
    a component, block by block."""
    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("component_id", "b1", "b2"), 1 << 30, 0):
            x, pid = _matrix(rows.column("vector").to_pylist()), rows.column("pid").to_numpy()
            own, copies = rows.column("own").to_numpy(), rows.column("copies").to_numpy()
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if rows.column("b1")[0].as_py() != rows.column("b2")[0].as_py():
                near &= own[:, None] != own[None, :]
            some = near.any(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid[some]), pa.array((near @ copies)[some]), pa.array(pid[roots(near)][some])],
                names=["pid", "links", "root"])

    sizes = durable(parts.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("blocks")))
    members = (
        parts.join(sizes, "component_id").join(unit.select("pid", "vector", "copies"), "pid")
        .withColumn("own", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("component_id", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"),
                "pid", "own", "copies", "vector")
    )
    keys = ["component_id", "b1", "b2"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "pid long, links long, root long")


def _audited(unit: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Recall of the links of a sample of at most about twice ``_AUDITED`` vectors, each compared with all."""
    n = unit.count()
    rate = F.pmod(F.xxhash64(F.lit(5), "pid"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, _AUDITED / max(1, n)))
    sample = unit.where(rate).select("pid", "label", "size", "vector").toPandas()
    groups = {key: (g.pid.to_numpy(), _matrix(list(g.vector))) for key, g in sample.groupby(["label", "size"])}

    def true(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _ROWS):
            rows = batch.select(["label", "size", "pid", "vector", "copies"]).to_pandas()
            for key, g in rows.groupby(["label", "size"]):
                if key in groups:
                    pid, x = groups[key]
                    near = _matrix(list(g.vector)) @ x.T >= threshold
                    near &= g.pid.to_numpy()[:, None] != pid[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(pid), pa.array(near.T @ g.copies.to_numpy())], names=["pid", "links"])

    want = unit.mapInArrow(true, "pid long, links long").agg(F.sum("links")).first()[0] or 0
    got = counts.join(unit.where(rate).select("pid"), "pid", "left_semi").agg(F.sum("links")).first()[0] or 0
    return got / want if want else 1.0
