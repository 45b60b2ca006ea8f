"""Uniqueness checks over the parts that may hold a value against checks over the whole table."""

import random

import pytest

from circdesk.operators import checks
from circdesk.sources.library import library_of, rows_of
from circdesk.sources.membership import Membership
from circdesk.sources.versions import Changes, Update, compact, current_release, publish, read_release
from tests.conftest import rows
from tests.test_publish import everything, files_read

KEYS = ["statement_id", "ma_doc_gia", "cot", "gia_tri", "ly_do"]
NEW = "statement_id bigint, ma_doc_gia bigint, cccd string, so_dien_thoai string"


def reader(i):
    return {"ma_doc_gia": i, "cccd": f"c{i}", "so_dien_thoai": None if i % 10 == 0 else f"p{i}"}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Three parts of readers, some changed numbers, and an index that has seen all but the last part."""
    base, folder = (str(tmp_path_factory.mktemp("members") / n) for n in ("lib", "index"))
    publish(spark, base, everything(library_of(spark, doc_gia=[reader(i) for i in range(3000)])))
    publish(spark, base, Changes({"doc_gia": rows_of(spark, "doc_gia", [reader(i) for i in range(5000, 5200)])}))
    change = spark.createDataFrame([(5, "p7000"), (6, None), (5001, "p1")], "ma_doc_gia bigint, so_dien_thoai string")
    publish(spark, base, Changes(updated={"doc_gia": Update(change, ["so_dien_thoai"])}))
    index = Membership(spark, base, folder)
    assert index.update() == 2 and index.update() == 0
    return base, index


def asked(spark, *people):
    return spark.createDataFrame(list(people), NEW)


def test_parts_without_a_hit_are_not_opened(spark, made):
    base, index = made
    first, second = [p.place for p in current_release(spark, base).parts["doc_gia"] if p.kind != "sua"]
    assert index.parts_for(asked(spark, (1, 1, "zzz", "yyy"), (2, 2, None, None))) == []
    assert index.parts_for(asked(spark, (1, 1, "c5010", None))) == [second]
    assert index.parts_for(asked(spark, (1, 1, "c12", "zz"))) == [first]
    nobody = index.holders(asked(spark, (1, 1, "zzz", "yyy")))
    assert files_read(nobody) <= 4 < files_read(read_release(spark, base).doc_gia)  # only the changed numbers


def test_few_strange_values_hit(spark, made):
    _, index = made
    strange = asked(spark, *[(i, i, f"s{i}", f"t{i}") for i in range(300)])
    hits = sum(bool(index.parts_for(strange.where(f"ma_doc_gia = {i}"))) for i in range(3))
    assert hits <= 1


@pytest.mark.parametrize("changed", [False, True])
def test_like_the_check_over_the_table(spark, made, changed):
    base, index = made
    rng = random.Random(2)
    people = [(i, rng.choice([i, 5, 6, 5001]) if changed else 9000 + i, rng.choice([f"c{rng.randint(0, 6000)}", None, f"x{i}"]),
               rng.choice([f"p{rng.randint(0, 6000)}", "p7000", "p5", "p6", "p5001", "p1", None])) for i in range(60)]
    batch = asked(spark, *people)
    tables = read_release(spark, base)
    plain = checks.check_unique_reader_update(tables, batch) if changed else checks.check_unique_reader(tables, batch, strict=True)
    ours = index.check(batch, strict=not changed, changed=changed)
    assert rows(ours.violations, *KEYS) == rows(plain.violations, *KEYS) != []
    assert rows(ours.accepted, "statement_id") == rows(plain.accepted, "statement_id")


def test_parts_that_are_not_indexed_are_read(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(library_of(spark, doc_gia=[reader(i) for i in range(20)])))
    index = Membership(spark, base, str(tmp_path / "index"))
    batch = asked(spark, (1, 100, "c3", None), (2, 101, "c30", None))
    assert rows(index.check(batch).violations, "statement_id") == [(1,)]
    index.update()
    publish(spark, base, Changes({"doc_gia": rows_of(spark, "doc_gia", [reader(30)])}))
    assert rows(index.check(batch).violations, "statement_id") == [(1,), (2,)]
    change = spark.createDataFrame([(3, "other")], "ma_doc_gia bigint, cccd string")
    publish(spark, base, Changes(updated={"doc_gia": Update(change, ["cccd"])}))
    assert rows(index.check(batch).violations, "statement_id") == [(2,)]
    compact(spark, base)
    index.update()
    assert rows(index.check(batch).violations, "statement_id") == [(2,)]
    assert rows(index.check(asked(spark, (3, 102, "other", None))).violations, "statement_id") == [(3,)]
