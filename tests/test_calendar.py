"""Time-driven work by day folders against full runs."""

import pytest

from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators import batches, measures, reports
from circdesk.sources import batches as src
from circdesk.sources.calendar import (
    CARDS,
    LINES,
    REQUESTS,
    Calendar,
    cards_to_lock,
    newly_expired_cards,
    newly_overdue,
    requests_to_reject,
)
from circdesk.sources.derived import AS_OF, derived_library
from circdesk.sources.library import read_library, write_library
from circdesk.sources.versions import changes_between, publish, read_release
from circdesk.streaming.intake import decisions_step, extensions_step, returns_step
from tests.conftest import SMALL, rows
from tests.test_publish import files_read

EARLIER = "2001-07-20 12:00:00"
LINE = ["ma_phieu_muon", "ma_sach"]


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("calendar") / "tables")
    write_library(derived_library(spark, SMALL), folder)
    return read_library(spark, folder)


@pytest.fixture(scope="module")
def calendar(spark, lib, tmp_path_factory):
    made = Calendar(spark, str(tmp_path_factory.mktemp("calendar") / "days"))
    made.add(lib)
    return made


def overdue(lib, moment):
    return set(rows(lib.chi_tiet.where(measures.is_overdue(moment)), *LINE))


def test_runs_add_up_to_a_full_run(lib, calendar):
    first = set(rows(newly_overdue(calendar, None, EARLIER), *LINE))
    second = set(rows(newly_overdue(calendar, EARLIER, AS_OF), *LINE))
    assert first == overdue(lib, EARLIER) and second and not first & second
    assert first | second == overdue(lib, AS_OF)
    in_debt = set(rows(cards_to_lock(calendar, None, EARLIER), "ma_the")) | set(rows(cards_to_lock(calendar, EARLIER, AS_OF), "ma_the"))
    assert in_debt == set(rows(measures.cards_in_debt(lib, AS_OF), "ma_the"))
    locked = batches.lock_overdue_cards(lib, AS_OF).where(f"trang_thai = '{V.BI_KHOA}'")
    assert in_debt <= set(rows(locked, "ma_the"))
    expired = set(rows(newly_expired_cards(calendar, None, EARLIER), "ma_the")) | set(
        rows(newly_expired_cards(calendar, EARLIER, AS_OF), "ma_the"))
    assert expired == set(rows(reports.expired_card_notice(lib, AS_OF), "ma_the"))
    rejected = set(rows(requests_to_reject(calendar, None, EARLIER), "ma_yeu_cau")) | set(
        rows(requests_to_reject(calendar, EARLIER, AS_OF), "ma_yeu_cau"))
    before = set(rows(lib.yeu_cau_gia_han.where(f"trang_thai = '{V.CHO}'"), "ma_yeu_cau"))
    after = set(rows(batches.auto_reject_requests(lib, AS_OF).where(f"trang_thai = '{V.CHO}'"), "ma_yeu_cau"))
    assert rejected == before - after and rejected


def test_a_later_run_opens_only_the_days_between(calendar):
    late = newly_overdue(calendar, EARLIER, AS_OF)
    early = newly_overdue(calendar, None, AS_OF)
    days, every = files_read(late), files_read(early)
    assert 0 < days <= 13 * 16 and every > 2 * days
    plan = late._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "/tables/" not in plan  # the tables are not read


def test_the_lists_follow_the_tables(spark, lib, tmp_path):
    base = str(tmp_path / "lib")
    calendar = Calendar(spark, str(tmp_path / "days"))
    publish(spark, base, {n: getattr(lib, n) for n in Tables.names()})
    calendar.add(read_release(spark, base))
    steps = [
        (returns_step(AS_OF), src.return_requests(lib).where("ma_phieu_muon % 3 = 0")),
        (extensions_step(), src.extension_applications(lib)),
        (decisions_step(), src.extension_decisions(lib)),
    ]
    for step, requests in steps:
        number = publish(spark, base, step(read_release(spark, base), requests))
        now = read_release(spark, base)
        for name in (LINES, CARDS, REQUESTS):
            calendar.follow(name, changes_between(spark, base, name, number - 1), now)
    for since, until in ((None, EARLIER), (EARLIER, AS_OF), (None, "2001-09-01 00:00:00")):
        want = overdue(now, until) - (overdue(now, since) if since else set())
        assert set(rows(newly_overdue(calendar, since, until), *LINE)) == want
    waiting = now.yeu_cau_gia_han.where(f"trang_thai = '{V.CHO}'")
    left = batches.auto_reject_requests(now, AS_OF).where(f"trang_thai = '{V.CHO}'")
    assert set(rows(requests_to_reject(calendar, None, AS_OF), "ma_yeu_cau")) == set(
        rows(waiting, "ma_yeu_cau")) - set(rows(left, "ma_yeu_cau"))
