import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from circdesk.llm.centroids import _WALSH, cluster_vectors, nearest
from circdesk.llm.hard_negatives import Index, hard_negatives

NAMES = ["vec_id", "embedding", "label", "rank", "v", "block", "cluster", "anchor", "distance"]
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in NAMES[3:]],
])


def _vectors(n, seed=1, size=64):
    """Random vectors in few directions, with repeated vectors, repeated rows and every unusable kind."""
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(6, size))
    rows = []
    for i in range(n):
        x = (middle[draw.integers(6)] + 0.6 * draw.normal(size=size)).astype(np.float32).tolist()
        rows.append((i, x, int(draw.integers(4))))
    rows += [(n + i, rows[5][1], rows[5][2] + i % 2) for i in range(20)]  # ties
    rows += [rows[7], rows[7]]
    bad = rows[3][1]
    rows += [(n + 30, None, 1), (n + 31, bad[:10], 1), (n + 32, [], 2), (n + 33, [None, *bad[1:]], 1),
             (n + 34, [math.nan, *bad[1:]], 1), (n + 35, [math.inf, *bad[1:]], 1), (n + 36, [0.0] * size, 1),
             (n + 37, bad, None), (None, bad, 1), (100, bad, 2) if n <= 100 else (n + 38, bad, 2), (n + 39, bad + [1.0], 1)]
    return [(*r, *"abcdef") for r in rows]


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _ints(v):
    return [math.floor(256 * x) for x in v]


def _clusters(rows, k, rounds):
    kept = [(r[0], _ints(r[1])) for r in rows if _usable(r[1]) and len(r[1]) == 64]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        at = [place(v)[1] for _, v in kept]
        for n in range(len(now)):
            own = [v for (_, v), c in zip(kept, at) if c == n]
            if own:
                now[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *place(v)) for i, v in kept]
    total = Counter()
    for _, d, c in found:
        total[c] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, c, d, total[c], sum(total.values()), marks[c]) for i, d, c in found)


@pytest.mark.parametrize("n, k", [(300, 40), (12, 40), (200, 3)])
def test_clusters_are_those_of_plain_search(spark, n, k):
    rows = _vectors(n)
    got = cluster_vectors(_frame(spark, rows), centroids=k, rounds=3).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == _clusters(rows, k, 3)


def test_search_through_coefficients_is_exact():
    draw = np.random.default_rng(4)
    x, c = draw.integers(-2**23, 2**23, (500, 64)), draw.integers(-2**23, 2**23, (30, 64))
    c[7] = c[3]
    x[:20] = c[3]
    best, distance = nearest(x @ _WALSH.T, c @ _WALSH.T)
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (best == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert (_WALSH @ _WALSH.T == 64 * np.eye(64)).all()


def test_no_vectors_no_clusters(spark):
    assert cluster_vectors(_frame(spark, [])).collect() == []
    assert cluster_vectors(_frame(spark, [(1, None, 1, *"abcdef"), (None, [0.5] * 64, 1, *"abcdef")])).collect() == []
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(_frame(spark, [(1, [1e30] * 64, 1, *"abcdef")])).collect()


def _negatives(rows):
    part = [(i, (label + 1) % 10 if i % 7 == 0 else label, _ints(v)) for i, v, label, *_ in rows
            if i is not None and label is not None and _usable(v)]
    out = Counter()
    for i, label, v in part:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in part if j != i)
        for s, j, _ in [x for x in scored if x[2]][:5]:
            fits = [(-t, k) for t, k, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out.update((i, j, rank, k, -s, t) for rank, (t, k) in enumerate(fits, 1))
    return out


@pytest.mark.parametrize("n, block, group", [(700, 8192, 2048), (700, 60, 3), (90, 7, 1), (0, 10, 10)])
def test_negatives_are_those_of_plain_search(spark, n, block, group):
    rows = _vectors(max(n, 20), seed=n) if n else []
    got = hard_negatives(_frame(spark, rows), block, group).collect()
    assert Counter(tuple(r) for r in got) == _negatives(rows)


def test_threshold_join_finds_every_pair():
    draw = random.Random(3)
    rng = np.random.default_rng(9)
    for _ in range(30):
        dims = draw.choice([1, 5, 8, 17, 64])
        rows = rng.integers(-300, 300, (draw.randint(1, 200), dims)) * rng.integers(0, 2, dims)
        anchors = rng.integers(-300, 300, (draw.randint(1, 40), dims))
        index, own = Index(rows, anchors), np.flatnonzero(rng.integers(0, 2, len(anchors)))
        scores = anchors[own] @ rows.T
        threshold = rng.choice([-np.inf, 0, 1e3, 1e5], len(own)) + 0.0
        a, r, s = index.above(own, threshold)
        want = np.argwhere(scores >= threshold[:, None])
        assert sorted(zip(a.tolist(), r.tolist())) == [tuple(x) for x in want.tolist()]
        assert (s == scores[a, r]).all()
