"""Tables in buckets of the slip id: joins of lines and slips without a shuffle of lines."""

import pytest

from circdesk.operators import batches, measures, reports
from circdesk.sources.derived import AS_OF, derived_library
from circdesk.sources.stored import BY_SLIP, read_bucketed, write_bucketed
from tests.conftest import SMALL, rows
from tests.test_plans import plan_of


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bucketed") / "tables")
    write_bucketed(derived_library(spark, SMALL), folder, 8)
    return read_bucketed(spark, folder, "kho", 8)


def test_the_tables_are_the_same(spark, stored):
    plain = derived_library(spark, SMALL)
    for name in BY_SLIP:
        ours, theirs = getattr(stored, name), getattr(plain, name)
        assert ours.exceptAll(theirs).isEmpty() and ours.count() == theirs.count()


def shuffles_above_lines(plan):
    """Exchanges through which rows of the stored lines go as they are, in a formatted plan's tree."""
    tree = plan[: plan.index("\n\n")].split("\n")
    found, path = 0, []
    for line in tree:
        depth = len(line) - len(line.lstrip(" :+-"))
        path = [(d, n) for d, n in path if d < depth] + [(depth, line.strip(" :+-*"))]
        if "Scan parquet" in line and "chi_tiet" in line:
            above = [n for _, n in path]
            last = max([i for i, n in enumerate(above) if "Aggregate" in n], default=0)
            found += sum(n.startswith("Exchange") for n in above[last:])
    return found


REPORTS = {
    "q1_fine_report": (lambda t: reports.fine_report(t, AS_OF), ["ma_phieu_muon", "ma_sach", "tien_phat"]),
    "q6_open_loans_per_card": (reports.open_loans_per_card, ["ma_the", "so_sach"]),
    "f1_overdue_debt": (lambda t: measures.overdue_debt(t, AS_OF), ["ma_the", "co_no_qua_han"]),
    "f6_reader_open_loans": (measures.reader_open_loans, ["ma_doc_gia", "so_sach_dang_muon"]),
    "s7_lock_overdue_cards": (lambda t: batches.lock_overdue_cards(t, AS_OF), ["ma_the", "trang_thai"]),
}


@pytest.mark.parametrize("name", list(REPORTS))
def test_no_shuffle_of_lines(spark, stored, name):
    build, columns = REPORTS[name]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Lines and slips are never sent whole, as in a large library; the fines need the books beside every line.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000" if name == "q1_fine_report" else "-1")
    try:
        df = build(stored)
        plan = plan_of(df)
        assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert shuffles_above_lines(plan) == 0, plan[: plan.index("\n\n")]
        assert rows(df, *columns) == rows(build(derived_library(spark, SMALL)), *columns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
