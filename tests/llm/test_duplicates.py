import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from circdesk.llm import embedding_dedup, jaccard_join, substring_dedup
from circdesk.llm.embedding_dedup import linked_vectors
from circdesk.llm.fm_index import repeats_before
from circdesk.llm.jaccard_join import shingles, similar_documents
from circdesk.llm.line_dedup import repeated_lines
from circdesk.llm.substring_dedup import without_repeats
from circdesk.llm.support import components, table
from tests.conftest import SMALL
from tests.llm.cases import awkward_rows, documents, passage


def _classes(ids, near):
    """Smallest id reachable from each row; rows without an id are in no class."""
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min([label[j] for j in others if label[j] is not None], default=label[i])
            if label[i] is not None and low < label[i]:
                label[i], changed = low, True
    return label


def _similar(rows):
    sets = [frozenset(shingles(t, 5).tolist()) for _, t in rows]
    near = [
        [j for j, b in enumerate(sets) if j != i and a and b and rows[i][0] is not None and rows[j][0] is not None
         and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)
    ]
    return near, _classes([i for i, _ in rows], near)


def _near_copies():
    """A group of copies that all differ, chains of slight changes, and passages that many share."""
    rows, common = [], passage(50, 30)
    base = passage(51, 120).split()
    for i in range(60):
        words = list(base)
        words[(i * 7) % 120] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    words = passage(52, 100).split()
    for i in range(25):
        words = [*words[:i * 4], f"c{i}", *words[i * 4 + 1:]]
        rows.append((300 + i, " ".join(words)))
    rows += [(400 + i, f"{passage(600 + i, 20 + i)} {common} {passage(700 + i, 30)}") for i in range(40)]
    return rows


@pytest.mark.parametrize("bucket", [200, 8])
def test_jaccard_links_match_brute_force(spark, bucket):
    rows = [*documents(awkward_rows()), *_near_copies()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near, label = _similar(rows)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in similar_documents(docs, bucket=bucket).collect())
    assert got == Counter((i, c, len(n)) for (i, _), c, n in zip(rows, label, near))


def test_jaccard_recall_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    near, label = _similar(rows)
    got = {r.doc_id: r for r in similar_documents(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    assert sum(got[i].n_links for i, _ in rows) >= 0.999 * sum(map(len, near))
    assert all((got[i].class_id == c) and got[i].kept == (c == i) for (i, _), c in zip(rows, label))


def test_jaccard_links_to_sets_that_left_with_a_pivot(spark):
    """Slight variations of one set, and pairs of which one set is similar to all of these, the other only to the first."""
    base = [f"b{i}" for i in range(200)]
    rows = [(1000 + i, " ".join([*base, f"u{i}", f"v{i}"])) for i in range(60)]
    for i in range(12):
        words = base[16 * i:] + base[:16 * i]
        x = [*words[20:], *[f"x{i}_{n}" for n in range(20)]]
        rows += [(100 + i, " ".join(x)), (i, " ".join([*x[20:], *[f"y{i}_{n}" for n in range(20)]]))]
    sets = [frozenset(t.split()) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if j != i and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = similar_documents(docs, shingle=1, bucket=8, recall=0.5).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in found} == {
        (i, c, len(n)) for (i, _), c, n in zip(rows, _classes([i for i, _ in rows], near), near)}


def test_vectors_with_full_lists_are_linked_across_groups(spark):
    """Two close groups in which one vector each is similar to one of the other group, which no list has room for."""
    draw = np.random.default_rng(8)
    a, b, *noise = np.linalg.qr(draw.normal(size=(64, 42)))[0].T
    def turned(angle, i):
        v = np.cos(angle) * a + np.sin(angle) * b + 0.004 * noise[i]
        return (v / np.linalg.norm(v)).tolist()
    end = np.arccos(0.98)
    rows = [(i, turned(0.0005 * i, i), 1) for i in range(20)]
    rows += [(20 + i, turned(0.0005 * 19 + end * 0.999 + 0.0005 * i, 20 + i), 1) for i in range(20)]
    x = np.array([v for _, v, _ in rows])
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    assert near[:20, 20:].sum() and not near[:20, 20:].all()
    found = linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(i, int(near[i].sum()), 0) for i in range(40)}


def test_all_members_of_a_known_class_stay_on_a_path(spark):
    sets = [(bytes([i]), 1) for i in range(40)]
    known = spark.createDataFrame([(s, b"c") for s, _ in sets[:30]], "sid binary, component_id binary")
    met = jaccard_join._met(spark.createDataFrame(sets, "sid binary, path long"), known).collect()
    assert sorted((bytes(r.sid), r.n) for r in met) == [(s, 40) for s, _ in sets]


def test_jaccard_of_nothing(nothing):
    assert similar_documents(nothing).collect() == []


def _passages(rows, window=20):
    """Words, removed words and the digest of the rest, by comparing all windows."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            key = tuple(words[s: s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = Counter()
    for i, t in rows:
        words, gone = (t or "").encode().split(), set()
        for s in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[s: s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [5000, 2])
def test_passages_match_brute_force(spark, most):
    shared = passage(80, 55)
    rows = [*documents(awkward_rows())]
    rows += [(500 + i, f"{passage(900 + i, i)} {shared} {passage(950 + i, 9)}") for i in range(40)]
    rows += [(600, "a b c d e f g h i j " * 12), (601, "a " * 70), (602, "x " + "a " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in without_repeats(docs, most=most).collect()) == _passages(rows)


def test_passages_of_nothing(nothing):
    assert without_repeats(nothing).collect() == []


def test_index_reports_earlier_windows():
    draw = np.random.default_rng(4)
    parts = [draw.integers(1, 4, n) for n in draw.integers(6, 30, 200)]
    count = [len(p) - 5 for p in parts]
    keys = np.split(draw.permutation(sum(count)), np.cumsum(count)[:-1])
    first = {}
    for p, k in zip(parts, keys):
        for i, key in enumerate(k):
            w = tuple(p[i: i + 6])
            first[w] = min(first.get(w, key), key)
    for p, k, found in zip(parts, keys, repeats_before(parts, keys, 6)):
        assert [bool(f) for f in found] == [first[tuple(p[i: i + 6])] < key for i, key in enumerate(k)]


_WORDS = re.compile("[^ \t-\r]+")


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[n + (len(a) >= len(b)):] == b[n + (len(b) >= len(a)):]


def _lines(rows):
    """Removed lines per document: same words as an earlier line, or one edit away and both long enough."""
    seen, out = [], {}
    for i, t in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        lines = [] if t is None else t.split("\n")
        gone = []
        for n, line in enumerate(lines):
            words = _WORDS.findall(line)
            if words and any(words == w or (len(words) >= 5 and len(w) >= 5 and _one_edit(words, w)) for w in seen):
                gone.append(n)
            seen.append(words)
        out[i] = (len(lines), len(gone), gone)
    return out


def test_lines_match_brute_force(spark):
    base = passage(30, 12).split()
    texts = ["\n".join([
        " ".join(base), " ".join(base[:i % 12] + ["new"] + base[i % 12:]), " ".join(base[:i % 12] + base[i % 12 + 1:]),
        " ".join(base[:i % 12] + [f"r{i}"] + base[i % 12 + 1:]), " ".join(reversed(base)) + f" {i}", "a b c", f"a b {i}", "",
    ]) for i in range(30)]
    rows = [*documents(awkward_rows()), *[(700 + i, t) for i, t in enumerate(texts)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed_lines)) for r in repeated_lines(docs).collect()}
    assert got == _lines(rows)


def test_lines_of_nothing(nothing):
    assert repeated_lines(nothing).collect() == []


def _vectors():
    draw = np.random.default_rng(8)
    rows = []
    for g in range(6):
        middle = draw.standard_normal(16)
        for n in range([1, 2, 40, 90, 5, 3][g]):
            rows.append((len(rows), (middle + 0.06 * draw.standard_normal(16)).tolist(), g % 2))
    rows += [(1000 + i, draw.standard_normal(16).tolist(), i % 3) for i in range(60)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(4)]  # equal vectors
    rows += [(3000, rows[5][1], None), (3001, None, 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1),
             (3004, [None, 1.0], 1), (None, rows[5][1], rows[5][2]), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1),
             (3008, [float("inf"), 1.0], 1), (3006, [1.0, 2.0], 1), (3009, [1e-300, 2e-300], 1)]
    return rows


def _linked(rows, threshold=0.98):
    def fine(r):
        return None not in (r[0], r[1], r[2]) and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    unit = [np.array(r[1]) / max(map(abs, r[1])) if fine(r) else None for r in rows]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b)
             and rows[i][2] == rows[j][2] and a @ b >= threshold] for i, a in enumerate(unit)]
    return near, _classes([r[0] for r in rows], near)


@pytest.mark.parametrize("neighbours", [8, 2])
def test_vectors_match_brute_force(spark, monkeypatch, neighbours):
    monkeypatch.setattr(embedding_dedup, "_BLOCK", 32)
    rows = _vectors()
    kind = "vec_id long, embedding array<double>, label int, size int, vector string, pid long, v long"
    vectors = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], kind).repartition(3)
    near, label = _linked(rows)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in linked_vectors(vectors, neighbours=neighbours).collect())
    assert got == Counter((r[0], len(n), c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, near, label))


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert linked_vectors(none).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)] + [(200, 201), (201, 200)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(51), 0) | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_families_around_one_core_are_all_found(spark):
    """450 texts share 110 words, so that their buckets are large; only the three of a family are similar."""
    core = passage(300, 110)
    rows = [(3 * f + i, f"{core} {passage(400 + f, 60)} {'x' * i} end") for f in range(150) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar_documents(docs).collect()}
    assert got == {i: (i - i % 3, 2) for i, _ in rows}


def test_a_class_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_BLOCK_SETS", 7)
    base = passage(77, 200).split()
    rows = [(i, " ".join([*base[:i % 190], f"w{i}", *base[i % 190 + 1:]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar_documents(docs, bucket=10).collect()}
    assert got == dict.fromkeys(range(60), (0, 59))


def test_no_document_is_lost(spark):
    docs = table(spark, SMALL, "documents")
    n = docs.count()
    assert similar_documents(docs).select(F.count_distinct("doc_id")).first()[0] == n
    assert jaccard_join.BUCKET > 1 and substring_dedup.WINDOW == 20


def test_a_passage_in_most_texts_is_not_followed():
    draw = np.random.default_rng(3)
    common = np.sort(draw.choice(1 << 40, 400, replace=False)).astype(np.uint64)
    starts = list(range(1, 11))
    for h in (0, 100, 320, 340, 400):  # common ones of 500; from 321 on they are followed too
        shared = []
        for _ in range(300):
            own = draw.choice(1 << 40, 500 - h + 56, replace=False).astype(np.uint64)
            both = [np.sort(np.concatenate([common[:h], part])) for part in (own[: 500 - h], own[56:])]  # similarity 0.8
            often = [jaccard_join._is_among(s, common) for s in both]
            first, second = (set(jaccard_join._chosen(s, starts, 0.8, 1.5, o).tolist()) for s, o in zip(both, often))
            shared.append(len(first & second) / len(starts))
            assert len(first) < 8 * len(starts)
        assert np.mean(shared) > 1.4
    passage_only = [jaccard_join._chosen(
        np.concatenate([common[:300], draw.choice(1 << 40, 200).astype(np.uint64)]), starts, 0.8, 1.5,
        np.arange(500) < 300) for _ in range(20)]
    assert len(np.unique(np.concatenate(passage_only))) == sum(len(p) for p in passage_only)  # no path of two texts
