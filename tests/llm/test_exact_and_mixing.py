import hashlib
from collections import Counter, defaultdict

import numpy as np

from circdesk.llm.exact_dedup import exact_duplicates
from circdesk.llm.mixing import mix, mixed_rows, pivot, source_targets
from tests.llm.cases import awkward_rows, documents


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_match_brute_force(awkward):
    got = exact_duplicates(awkward, carry=["row", "kept"]).collect()
    groups = defaultdict(list)
    for i, t in documents(awkward_rows()):
        groups[hashlib.sha256(_lower(t).encode()).hexdigest()].append(i)
    assert Counter((r.text_sha256, r.doc_id) for r in got) == Counter((k, i) for k, ids in groups.items() for i in ids)
    for sha, ids in groups.items():
        rows = [r for r in got if r.text_sha256 == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in rows} == {(best, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [best]
    assert {r.row for r in got} == {"y"}


def test_a_text_that_many_rows_share_goes_over_many_ranges(spark):
    rows = spark.range(4000).selectExpr("id doc_id", "if(id % 3 = 0, 'Same Text', concat('t', id)) text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_duplicates(rows).where("group_size > 1").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 1334 and {(r.keep_id, r.group_size) for r in got} == {(3999, 1334)}
    assert [r.doc_id for r in got if r.kept] == [3999]


def test_exact_of_nothing(nothing):
    assert exact_duplicates(nothing).collect() == []


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_share_the_excess_again(spark):
    for sizes in ({"a": 10, "b": 500, "c": 3, None: 70}, {"x": 5}, {"é": 0, "a": 9, "Z": 100, "b": 1, None: 0}):
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = _targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want), (got, want)


def test_mix_comes_near_its_targets(spark):
    draw = np.random.default_rng(3)
    rows = [(i, "w " * int(n), f"s{i % 5}" if i % 3 else "hot") for i, n in enumerate(draw.lognormal(4, 1.5, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix(docs, group_rows=200).collect()
    again = mix(docs.repartition(2), group_rows=200).collect()
    assert sorted(got) == sorted(again)
    taken, target = Counter(), {}
    for r in got:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.002 * target[s] + 5 for s in target), (taken, target)


def test_mix_of_awkward_rows(awkward, nothing):
    got = mix(awkward).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in documents(awkward_rows()))
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3, 14))
    assert len({(r.size, r.copies) for r in got if r.doc_id == 5 and r.source == "a"}) == 1
    out = mixed_rows(awkward)
    assert out.columns == awkward.columns
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert mix(nothing).collect() == [] and mixed_rows(nothing).collect() == []


def test_pivot_keeps_the_words_and_is_fair():
    draw = np.random.default_rng(0)
    words, part = draw.integers(1, 50, 40).astype(float), draw.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out = pivot(words, part, draw.random(40), 40)
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert abs((words * (out - part)).sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - part).max() < 0.06
