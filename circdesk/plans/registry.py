"""Every operator as a query over the tables of a scale-factor folder.

Each entry derives the library (and, for checks and batches, the request batch) from all rows of
the source tables inside its own plan, so the planner prunes what the query does not need.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circdesk.functions.sql import register_functions
from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators import batches as B
from circdesk.operators import cataloguing, checks, in_order, lending, measures, reports
from circdesk.operators.deltas import append_rows, apply_changes
from circdesk.sources import batches as src
from circdesk.operators.scratch import scratch_folder
from circdesk.sources.calendar import Calendar, cards_to_lock
from circdesk.sources.derived import AS_OF, derived_library
from circdesk.sources.stored import read_bucketed, write_bucketed
from circdesk.sources.versions import Changes, changes_between, compact, publish, read_release
from circdesk.streaming.intake import extensions_step, returns_step

Query = Callable[[SparkSession, str], DataFrame]

EARLIER = "2001-07-01 00:00:00"  # a moment before AS_OF
CLOSED_COLUMNS = ["ngay_tra_thuc_te", "trang_thai_muon", "trang_thai_sach"]


def _on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(derived_library(spark, sf_dir))


def _on_lines(build: Callable[[Tables], DataFrame]) -> Query:
    """Over a library whose lines are written once, since the query needs them several times."""
    return lambda spark, sf_dir: build(derived_library(spark, sf_dir, written=True))


def _on_batch(
    build: Callable[[Tables, DataFrame], DataFrame],
    batch: Callable[[SparkSession, str], DataFrame],
) -> Query:
    return lambda spark, sf_dir: build(derived_library(spark, sf_dir), batch(spark, sf_dir))


def _lines_of(n: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: src.inserted_lines(spark, sf_dir, per_statement=n)


def _in_sql(text: str, written: bool = False) -> Query:
    """A query given as SQL text that calls the library's functions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_functions(spark, derived_library(spark, sf_dir, written), "tv_")
        return spark.sql(text.format(luc=f"timestamp_ntz '{AS_OF}'"))

    return run


def _released(spark: SparkSession, sf_dir: str, step: Callable[[Tables], Changes]) -> str:
    """A folder with the library as its first release, and the outcome of one step as its second."""
    base = f"{scratch_folder(spark).rstrip('/')}/circdesk/library-{uuid.uuid4().hex}"
    tables = derived_library(spark, sf_dir, written=True)
    publish(spark, base, {n: getattr(tables, n) for n in Tables.names()})
    publish(spark, base, step(read_release(spark, base)))
    return base


def _on_release(step: Callable[[Tables], Changes], build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(read_release(spark, _released(spark, sf_dir, step)))


def _returns(t: Tables) -> Changes:
    return returns_step(AS_OF)(t, src.return_requests(t))


def _extensions(t: Tables) -> Changes:
    return extensions_step()(t, src.extension_applications(t))


def _restock_of_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = changes_between(spark, _released(spark, sf_dir, _returns), "chi_tiet", 1)
    # every line came back in a statement of its own; a slip has a book once
    return checks.restock_on_return(feed.before, feed.after.withColumn("statement_id", F.col("ma_phieu_muon")))


def _compacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _released(spark, sf_dir, _extensions)
    compact(spark, base)
    return read_release(spark, base).chi_tiet


def _requests_for_first_line(t: Tables) -> DataFrame:
    """The keyed form on the line of the first stored request."""
    first = t.yeu_cau_gia_han.select(F.min_by(F.struct("ma_phieu_muon", "ma_sach"), "ma_yeu_cau").alias("k")).first().k
    return reports.requests_for_line(t, *(first or (None, None)))


def _with_new_books(spark: SparkSession, sf_dir: str) -> Tables:
    tables = derived_library(spark, sf_dir)
    return tables.having(sach=append_rows(tables.sach, cataloguing.ingest_books(tables, src.new_books(spark, sf_dir)).books))


def _bucketed(build: Callable[[Tables], DataFrame]) -> Query:
    """Over the library written in buckets of the slip id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = f"kho_{uuid.uuid4().hex}"
        folder = f"{scratch_folder(spark).rstrip('/')}/circdesk/{name}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        write_bucketed(derived_library(spark, sf_dir), folder, buckets)
        return build(read_bucketed(spark, folder, name, buckets))

    return run


def _locked_in_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards locked up to a moment, and then those that the days since then put into debt."""
    tables = derived_library(spark, sf_dir)
    calendar = Calendar(spark, f"{scratch_folder(spark).rstrip('/')}/circdesk/days-{uuid.uuid4().hex}")
    calendar.add(tables)
    cards = cards_to_lock(calendar, None, EARLIER).unionByName(cards_to_lock(calendar, EARLIER, AS_OF)).distinct()
    return apply_changes(
        tables.the_thu_vien, cards.withColumn("trang_thai", F.lit(V.BI_KHOA)), ["ma_the"], ["trang_thai"])


def _statuses_set(t: Tables) -> B.StatusSet:
    return B.bulk_status_set(t, src.returned_lines(t))


QUERIES: dict[str, Query] = {
    # -- computations
    "f1_overdue_debt": _on_tables(lambda t: measures.overdue_debt(t, AS_OF)),
    "f1_overdue_debt_by_reader": _on_tables(
        lambda t: measures.overdue_debt(t, AS_OF, by="reader")
    ),
    "f2_stock_open4": _on_tables(measures.stock_open4),
    "f3_fine_replacement": _on_tables(lambda t: measures.fine_replacement(t, AS_OF)),
    "f3_fine_replacement_given_condition": _on_lines(
        lambda t: measures.fine_replacement(
            t, AS_OF, src.return_requests(t).select("ma_phieu_muon", "ma_sach", "trang_thai_sach")
        )
    ),
    "f4_fine_additive": _on_tables(lambda t: measures.fine_additive(t, AS_OF)),
    "f5_stock_open2": _on_tables(measures.stock_open2),
    "f6_reader_open_loans": _on_tables(measures.reader_open_loans),
    # -- reports and lookups
    "q1_fine_report": _on_tables(lambda t: reports.fine_report(t, AS_OF)),
    "q1_fine_report_replacement": _on_tables(
        lambda t: reports.fine_report(t, AS_OF, policy="replacement")
    ),
    "q2_stock_report": _on_tables(reports.stock_report),
    "q3_reader_loan_report": _on_tables(reports.reader_loan_report),
    "q4_loans_per_book": _on_tables(reports.loans_per_book),
    "q5_borrowed_books": _on_tables(reports.borrowed_books),
    "q6_open_loans_per_card": _on_tables(reports.open_loans_per_card),
    "q7_requests_for_line": _on_tables(reports.requests_for_line),
    "q8_lookup_slips": _on_tables(lambda t: reports.lookup(t.phieu_muon)),
    "q8_lookup_lines": _on_tables(lambda t: reports.lookup(t.chi_tiet)),
    "q8_lookup_requests": _on_tables(lambda t: reports.lookup(t.yeu_cau_gia_han)),
    # The key values of these three belong to the studied statements themselves.
    "q8_lookup_book_by_key": _on_tables(lambda t: reports.lookup(t.sach, ma_sach=4)),
    "q8_lookup_lines_by_slip": _on_tables(lambda t: reports.lookup(t.chi_tiet, ma_phieu_muon=3)),
    "q7_requests_for_one_line": _on_tables(lambda t: reports.requests_for_line(t, 13, 7)),
    "q9_bulk_stock_decrement": _on_tables(
        lambda t: checks.stock_after(t, B.bulk_stock_decrement(t, t.phieu_muon))
    ),
    "q10_bulk_status_set": _on_tables(lambda t: _statuses_set(t).lines),
    "q11_append_lines": _on_batch(
        lambda t, rows: append_rows(t.chi_tiet, checks.check_new_lines(t, rows).accepted),
        _lines_of(1),
    ),
    "q11_append_requests": _on_tables(
        lambda t: append_rows(
            t.yeu_cau_gia_han, checks.check_single_extension(t, src.inserted_extensions(t)).accepted
        )
    ),
    # -- notices
    "n1_expired_card_notice": _on_tables(lambda t: reports.expired_card_notice(t, AS_OF)),
    "n2_rarely_borrowed_notice": _on_tables(
        lambda t: reports.rarely_borrowed_notice(t, threshold=20)
    ),
    # -- admission checks
    "t1_check_stock": _on_batch(
        lambda t, rows: checks.check_stock(t, rows).violations, _lines_of(4)
    ),
    "t1_stock_after": _on_batch(
        lambda t, rows: checks.stock_after(t, checks.check_stock(t, rows).stock_change),
        _lines_of(1),
    ),
    "t2_restock_on_return": _on_tables(
        lambda t: checks.restock_on_return(t.chi_tiet, src.returned_lines(t))
    ),
    "t2_restock_on_return_literal": _on_tables(
        lambda t: checks.restock_on_return(t.chi_tiet, src.returned_lines(t), vocab="literal")
    ),
    "t3_check_card": _on_batch(
        lambda t, rows: checks.check_card(t, rows, AS_OF).violations, src.inserted_slips
    ),
    "t3_accepted_slips": _on_batch(
        lambda t, rows: checks.check_card(t, rows, AS_OF).accepted, src.inserted_slips
    ),
    "t4_check_loan_limit": _on_batch(
        lambda t, rows: checks.check_loan_limit(t, rows).violations, _lines_of(20)
    ),
    "t1_t4_check_new_lines": _on_batch(
        lambda t, rows: checks.check_new_lines(t, rows).violations, _lines_of(2)
    ),
    "t1_t4_admit_statements": _on_batch(
        lambda t, rows: lending.admit_statements(t, rows).select(
            "statement_id", "ma_phieu_muon", "ma_sach"
        ),
        _lines_of(2),
    ),
    "t5_check_single_extension": _on_lines(
        lambda t: checks.check_single_extension(t, src.inserted_extensions(t)).violations
    ),
    "t5_check_single_extension_strict": _on_lines(
        lambda t: checks.check_single_extension(
            t, src.inserted_extensions(t), strict=True
        ).violations
    ),
    "t6_check_unique_reader": _on_tables(
        lambda t: checks.check_unique_reader(t, src.inserted_readers(t)).violations
    ),
    "t6_check_unique_staff": _on_tables(
        lambda t: checks.check_unique_staff(t, src.inserted_staff(t)).violations
    ),
    "s5_check_unique_reader_update": _on_tables(
        lambda t: checks.check_unique_reader_update(t, src.changed_readers(t)).violations
    ),
    "s5_check_unique_staff_update": _on_tables(
        lambda t: checks.check_unique_staff_update(t, src.changed_staff(t)).violations
    ),
    "s6_check_book_delete": _on_tables(
        lambda t: checks.check_book_delete(
            t, t.sach.select("ma_sach", F.col("ma_sach").alias("statement_id"))
        ).violations
    ),
    # -- circulation batches
    "p1_screen_loans": _on_batch(
        lambda t, rows: lending.screen_loans(t, rows, AS_OF), src.loan_requests
    ),
    "p1_create_loans": _on_batch(
        lambda t, rows: lending.create_loans(t, rows, AS_OF).outcome, src.loan_requests
    ),
    "p1_create_loans_lines": _on_batch(
        lambda t, rows: lending.create_loans(t, rows, AS_OF).lines, src.loan_requests
    ),
    "p1_create_loans_on_shelf": _on_batch(
        lambda t, rows: lending.create_loans(t, rows, AS_OF, so_luong_is="on_shelf").slips,
        src.loan_requests,
    ),
    "p2_apply_extensions": _on_lines(
        lambda t: B.apply_extensions(t, src.extension_applications(t)).outcome
    ),
    "p2_lines_after": _on_lines(
        lambda t: apply_changes(
            t.chi_tiet,
            B.apply_extensions(t, src.extension_applications(t)).line_changes,
            B.LINE,
            ["ngay_tra_du_kien", "trang_thai_muon"],
        )
    ),
    "p3_process_returns": _on_lines(
        lambda t: B.process_returns(t, src.return_requests(t), AS_OF).outcome
    ),
    "p3_invoices": _on_lines(
        lambda t: B.process_returns(t, src.return_requests(t), AS_OF).invoices
    ),
    "p3_lines_after": _on_lines(
        lambda t: apply_changes(
            t.chi_tiet,
            B.process_returns(t, src.return_requests(t), AS_OF).line_changes,
            B.LINE,
            CLOSED_COLUMNS,
        )
    ),
    "p3_restock": _on_lines(
        lambda t: B.process_returns(t, src.return_requests(t), AS_OF).stock_change
    ),
    "p4_ingest_books": _on_batch(
        lambda t, rows: cataloguing.ingest_books(t, rows).outcome, src.new_books
    ),
    "p4_new_authors": _on_batch(
        lambda t, rows: cataloguing.ingest_books(t, rows).authors, src.new_books
    ),
    "p4_new_links": _on_batch(
        lambda t, rows: cataloguing.ingest_books(t, rows).links, src.new_books
    ),
    "p5_patch_accounts": _on_batch(
        lambda t, rows: B.patch_accounts(t, rows).outcome, src.account_patches
    ),
    "p5_staff_after": _on_batch(
        lambda t, rows: apply_changes(
            t.nhan_vien, B.patch_accounts(t, rows).staff_changes, ["ma_nhan_vien"],
            ["password", "trang_thai"],
        ).select("ma_nhan_vien", "username", "password", "trang_thai"),
        src.account_patches,
    ),
    "p5_readers_after": _on_batch(
        lambda t, rows: apply_changes(
            t.doc_gia, B.patch_accounts(t, rows).reader_changes, ["ma_doc_gia"],
            ["password", "trang_thai"],
        ).select("ma_doc_gia", "username", "password", "trang_thai"),
        src.account_patches,
    ),
    "p6_decide_extensions": _on_lines(
        lambda t: B.decide_extensions(t, src.extension_decisions(t)).outcome
    ),
    "p6_requests_after": _on_lines(
        lambda t: apply_changes(
            t.yeu_cau_gia_han,
            B.decide_extensions(t, src.extension_decisions(t)).request_changes,
            ["ma_yeu_cau"],
            ["trang_thai"],
        )
    ),
    "p6_lines_after": _on_lines(
        lambda t: apply_changes(
            t.chi_tiet,
            B.decide_extensions(t, src.extension_decisions(t)).due_changes,
            B.LINE,
            ["ngay_tra_du_kien"],
        )
    ),
    "p7_cancel_cards": _on_batch(
        lambda t, rows: B.cancel_cards(t, rows).outcome, src.cancellation_requests
    ),
    "p7_cards_after": _on_batch(
        lambda t, rows: apply_changes(
            t.the_thu_vien, B.cancel_cards(t, rows).card_changes, ["ma_the"], ["trang_thai"]
        ),
        src.cancellation_requests,
    ),
    "p7_readers_after": _on_batch(
        lambda t, rows: apply_changes(
            t.doc_gia, B.cancel_cards(t, rows).reader_changes, ["ma_doc_gia"], ["trang_thai"]
        ).select("ma_doc_gia", "trang_thai"),
        src.cancellation_requests,
    ),
    # -- known only from the requirements
    "s1_books_by_author": _on_tables(reports.books_by_author),
    "s2_books_by_category": _on_tables(reports.books_by_category),
    "s3_overdue_books_of_reader": _on_tables(
        lambda t: reports.overdue_books_of_reader(t, AS_OF)
    ),
    "s4_reader_name_of_card": _on_tables(reports.reader_name_of_card),
    "s7_lock_overdue_cards": _on_tables(lambda t: B.lock_overdue_cards(t, AS_OF)),
    "s8_classify_income": _on_tables(reports.classify_income),
    "s9_auto_reject_requests": _on_tables(lambda t: B.auto_reject_requests(t, AS_OF)),
    "s10_top_books": _on_tables(reports.top_books),
    "s11_overdue_readers": _on_tables(lambda t: reports.overdue_readers(t, AS_OF)),
    "s12_revenue_by_day": _on_tables(lambda t: reports.revenue_by_period(t, "day")),
    "s12_revenue_by_month": _on_tables(lambda t: reports.revenue_by_period(t, "month")),
    "s12_revenue_by_quarter": _on_tables(lambda t: reports.revenue_by_period(t, "quarter")),
    "s12_revenue_by_year": _on_tables(lambda t: reports.revenue_by_period(t, "year")),
    "s13_category_status": _on_tables(reports.category_status),
    "s14_damage_ratio_by_month": _on_tables(lambda t: reports.damage_ratio(t, "month")),
    "s14_damage_ratio_by_quarter": _on_tables(lambda t: reports.damage_ratio(t, "quarter")),
    "s14_damage_ratio_by_year": _on_tables(lambda t: reports.damage_ratio(t, "year")),
    "s15_cards_expiring": _on_tables(lambda t: reports.cards_expiring(t, AS_OF)),
    # -- releases: new values over old files, changes between two of them, counts kept up
    "p3_release_lines_after": _on_release(_returns, lambda t: t.chi_tiet),
    "p2_release_lines_compacted": _compacted_lines,
    "t2_restock_of_release": _restock_of_release,
    "f2_stock_of_release": _on_release(_returns, measures.stock_open4),
    "f6_open_loans_of_release": _on_release(_extensions, measures.reader_open_loans),
    "q7_requests_for_first_line": _on_tables(_requests_for_first_line),
    "n2_rarely_borrowed_with_new_books": lambda spark, sf_dir: reports.rarely_borrowed_notice(
        _with_new_books(spark, sf_dir), threshold=2
    ),
    # -- stored layouts, days since the last run, and checks in statement order
    "q1_fine_report_bucketed": _bucketed(lambda t: reports.fine_report(t, AS_OF)),
    "q6_open_loans_per_card_bucketed": _bucketed(reports.open_loans_per_card),
    "s7_lock_overdue_cards_in_two_runs": _locked_in_two_runs,
    "t5_admit_extensions": _on_lines(lambda t: in_order.admit_extensions(t, src.inserted_extensions(t))),
    "t6_admit_readers": _on_tables(lambda t: in_order.admit_readers(t, src.inserted_readers(t))),
    # -- the computations called from SQL text
    "f1_overdue_debt_sql": _in_sql("SELECT ma_the, tv_the_no_qua_han(ma_the, {luc}) AS co_no_qua_han FROM tv_the_thu_vien"),
    "f1_overdue_debt_by_reader_sql": _in_sql(
        "SELECT ma_doc_gia, tv_doc_gia_no_qua_han(ma_doc_gia, {luc}) AS co_no_qua_han FROM tv_doc_gia"
    ),
    "f2_stock_open4_sql": _in_sql("SELECT ma_sach, tv_so_con_lai_bon_trang_thai(ma_sach) AS so_luong_con_lai FROM tv_sach"),
    "f3_fine_replacement_sql": _in_sql(
        "SELECT ma_phieu_muon, ma_sach, tv_tien_phat_thay_the(ma_phieu_muon, ma_sach, trang_thai_sach, {luc}) AS tien_phat "
        "FROM tv_chi_tiet",
        written=True,
    ),
    "f4_fine_additive_sql": _in_sql(
        "SELECT ma_phieu_muon, ma_sach, tv_tien_phat_cong_don(ma_phieu_muon, ma_sach, {luc}) AS tien_phat FROM tv_chi_tiet",
        written=True,
    ),
    "q1_fine_report_sql": _in_sql(
        "SELECT ma_doc_gia, ho_ten AS ten_doc_gia, c.ma_phieu_muon, c.ma_sach, ten_sach, trang_thai_muon, trang_thai_sach, "
        "tv_tien_phat_cong_don(c.ma_phieu_muon, c.ma_sach, {luc}) AS tien_phat "
        "FROM tv_chi_tiet c JOIN tv_phieu_muon USING (ma_phieu_muon) JOIN tv_the_thu_vien USING (ma_the) "
        "JOIN tv_doc_gia USING (ma_doc_gia) JOIN tv_sach s ON s.ma_sach = c.ma_sach "
        f"WHERE trang_thai_muon IN {V.FINE_REPORT}"
    ),
    "q2_stock_report_sql": _in_sql(
        "SELECT ma_sach, ten_sach, so_luong, tv_so_con_lai_hai_trang_thai(ma_sach) AS so_luong_con_lai FROM tv_sach"
    ),
    "q3_reader_loan_report_sql": _in_sql(
        "SELECT ma_doc_gia, ho_ten, tv_so_sach_dang_giu(ma_doc_gia) AS so_sach_dang_muon FROM tv_doc_gia"
    ),
    "s1_books_by_author_sql": _in_sql(
        "SELECT ma_tac_gia, f.ma_sach, f.ten_sach FROM tv_tac_gia t, LATERAL tv_sach_cua_tac_gia(t.ma_tac_gia) f"
    ),
    "s2_books_by_category_sql": _in_sql(
        "SELECT ma_the_loai, f.ma_sach, f.ten_sach FROM tv_the_loai t, LATERAL tv_sach_cua_the_loai(t.ma_the_loai) f"
    ),
    "s3_overdue_books_of_reader_sql": _in_sql(
        "SELECT ma_doc_gia, f.* FROM tv_doc_gia g, LATERAL tv_sach_qua_han_cua_doc_gia(g.ma_doc_gia, {luc}) f"
    ),
    "s4_reader_name_of_card_sql": _in_sql("SELECT ma_the, tv_ten_doc_gia_cua_the(ma_the) AS ho_ten FROM tv_the_thu_vien"),
}

FLAGSHIP = "q1_fine_report"
