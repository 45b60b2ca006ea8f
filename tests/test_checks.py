import pytest

from circdesk.model import vocab as V
from circdesk.operators import batches, checks, lending
from circdesk.operators.deltas import append_rows
from circdesk.sources.library import library_of
from tests.conftest import NOW, day, rows

LINES = "statement_id bigint, ma_phieu_muon bigint, ma_sach bigint"


@pytest.fixture(scope="module")
def lib(spark):
    held = [
        {"ma_phieu_muon": 1, "ma_sach": 100 + k, "trang_thai_muon": V.DANG_MUON} for k in range(4)
    ]
    return library_of(
        spark,
        sach=[
            {"ma_sach": 5, "so_luong": 1}, {"ma_sach": 6, "so_luong": 9},
            {"ma_sach": 7, "so_luong": None},
            *[{"ma_sach": 100 + k, "so_luong": 1} for k in range(4)],
        ],
        the_thu_vien=[
            {"ma_the": 1, "trang_thai": V.HOAT_DONG, "ngay_het_han": day(NOW)},
            {"ma_the": 2, "trang_thai": V.BI_KHOA, "ngay_het_han": day("2002-01-01")},
            {"ma_the": 3, "trang_thai": V.HOAT_DONG, "ngay_het_han": day("2001-07-31")},
            {"ma_the": 4, "trang_thai": None, "ngay_het_han": None},
        ],
        phieu_muon=[
            {"ma_phieu_muon": 1, "ma_the": 1}, {"ma_phieu_muon": 2, "ma_the": 2},
            {"ma_phieu_muon": 3, "ma_the": 1},
        ],
        chi_tiet=[
            *held,
            {"ma_phieu_muon": 2, "ma_sach": 5, "trang_thai_muon": V.TRE_HAN},
            {"ma_phieu_muon": 3, "ma_sach": 5, "trang_thai_muon": V.DA_GIA_HAN},
        ],
        yeu_cau_gia_han=[{"ma_yeu_cau": 1, "ma_phieu_muon": 1, "ma_sach": 100, "trang_thai": V.TU_CHOI}],
        doc_gia=[
            {"ma_doc_gia": 1, "cccd": "c1", "so_dien_thoai": "p1"},
            {"ma_doc_gia": 2, "cccd": None, "so_dien_thoai": "p2"},
        ],
        nhan_vien=[{"ma_nhan_vien": 1, "cccd": "c9", "so_dien_thoai": "p9"}],
    )


def test_stock_rejects_the_whole_statement(spark, lib):
    new = spark.createDataFrame(
        [(1, 1, 5), (1, 2, 5), (1, 2, 6), (2, 1, 5), (3, 1, 7), (3, 1, 8)], LINES
    )
    result = checks.check_stock(lib, new)
    assert rows(result.violations, "statement_id", "ma_sach", "nhu_cau", "so_luong") == [(1, 5, 2, 1)]
    assert rows(result.accepted, "statement_id", "ma_sach") == [(2, 5), (3, 7), (3, 8)]
    after = checks.stock_after(lib, result.stock_change)
    assert rows(after.where("ma_sach < 100"), "ma_sach", "so_luong") == [(5, 0), (6, 9), (7, None)]


def test_a_batch_without_statements_is_one_statement(spark, lib):
    new = spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "ma_phieu_muon bigint, ma_sach bigint")
    result = checks.check_stock(lib, new)
    assert result.accepted.count() == 0
    assert result.violations.count() == 1


def test_loan_limit_is_per_card(spark, lib):
    new = spark.createDataFrame([(1, 1, 6), (2, 1, 6), (2, 3, 7), (3, 99, 6), (4, 2, 6)], LINES)
    result = checks.check_loan_limit(lib, new)
    assert rows(result.violations, "statement_id", "ma_the", "muon_moi", "dang_muon") == [(2, 1, 2, 4)]
    assert rows(result.accepted, "statement_id") == [(1,), (3,), (4,)]


def test_both_line_rules_compose_and_append(spark, lib):
    new = spark.createDataFrame([(1, 2, 5), (2, 1, 6), (2, 3, 6), (3, 2, 6)], LINES)
    result = checks.check_new_lines(lib, new)
    assert rows(result.violations, "statement_id", "ly_do", "khoa") == [(2, "loan_limit", 1)]
    assert append_rows(lib.chi_tiet, result.accepted).count() == lib.chi_tiet.count() + 2
    assert rows(result.stock_change, "ma_sach", "them") == [(5, -1), (6, -1)]


def test_statements_in_order_use_up_stock(spark, lib):
    new = spark.createDataFrame(
        [(1, 2, 5), (2, 2, 5), (2, 2, 6), (3, 2, 6), (4, 1, 6), (5, 3, 6)], LINES
    )
    assert rows(lending.admit_statements(lib, new), "statement_id", "ma_sach") == [
        (1, 5), (3, 6), (4, 6)
    ]


def test_cards(spark, lib):
    new = spark.createDataFrame(
        [(1, 10, 1), (2, 11, 2), (2, 12, 1), (3, 13, 3), (4, 14, 4), (5, 15, 99)],
        "statement_id bigint, ma_phieu_muon bigint, ma_the bigint",
    )
    result = checks.check_card(lib, new, NOW)
    assert rows(result.violations, "statement_id", "ma_the", "ly_do") == [
        (2, 2, "card_not_active"), (3, 3, "card_expired")
    ]
    assert rows(result.accepted, "statement_id") == [(1,), (4,), (5,)]


def test_single_extension(spark, lib):
    new = spark.createDataFrame([(1, 1, 100), (2, 2, 5), (3, 2, 5), (4, 3, 5)], LINES)
    plain = checks.check_single_extension(lib, new)
    assert rows(plain.accepted, "statement_id") == [(2,), (3,), (4,)]
    strict = checks.check_single_extension(lib, new, strict=True)
    assert rows(strict.accepted, "statement_id") == [(4,)]
    assert rows(strict.violations, "statement_id", "ly_do") == [
        (1, "already_requested"), (2, "repeated_in_batch"), (3, "repeated_in_batch")
    ]


PEOPLE = "statement_id bigint, {} bigint, cccd string, so_dien_thoai string"


def test_unique_people(spark, lib):
    new = spark.createDataFrame(
        [(1, 11, "c1", "x"), (2, 12, "y", "p2"), (3, 13, None, "z"), (4, 14, "c9", "p9"), (5, 15, "q", "z")],
        PEOPLE.format("ma_doc_gia"),
    )
    plain = checks.check_unique_reader(lib, new)
    assert rows(plain.violations, "statement_id", "cot", "gia_tri") == [
        (1, "cccd", "c1"), (2, "so_dien_thoai", "p2")
    ]
    assert rows(plain.accepted, "statement_id") == [(3,), (4,), (5,)]
    strict = checks.check_unique_reader(lib, new, strict=True)
    assert rows(strict.accepted, "statement_id") == [(4,)]
    staff = checks.check_unique_staff(lib, new.withColumnRenamed("ma_doc_gia", "ma_nhan_vien"))
    assert rows(staff.accepted, "statement_id") == [(1,), (2,), (3,), (5,)]


def test_updates_may_keep_their_own_values(spark, lib):
    changed = spark.createDataFrame(
        [(1, 1, "c1", "p1"), (2, 2, "c1", "p2")], PEOPLE.format("ma_doc_gia")
    )
    result = checks.check_unique_reader_update(lib, changed)
    assert rows(result.violations, "statement_id", "cot") == [(2, "cccd")]


def test_book_delete(spark, lib):
    gone = spark.createDataFrame([(1, 100), (1, 6), (2, 5)], "statement_id bigint, ma_sach bigint")
    result = checks.check_book_delete(lib, gone)
    assert rows(result.violations, "statement_id", "ma_sach") == [(1, 100)]
    assert rows(result.accepted, "statement_id", "ma_sach") == [(2, 5)]


def returned(spark, statements, status, condition):
    return spark.createDataFrame(
        [(statements[0], 2, 5, status, condition), (statements[1], 3, 5, status, condition)],
        "statement_id bigint, ma_phieu_muon bigint, ma_sach bigint, trang_thai_muon string, trang_thai_sach string",
    )


def test_restock_counts_a_book_once_per_statement(spark, lib):
    one = returned(spark, (1, 1), V.DA_TRA, V.TOT)
    two = returned(spark, (1, 2), V.DA_TRA, V.TOT)
    assert rows(checks.restock_on_return(lib.chi_tiet, one), "ma_sach", "them") == [(5, 1)]
    assert rows(checks.restock_on_return(lib.chi_tiet, two), "ma_sach", "them") == [(5, 2)]


def test_restock_vocabularies(spark, lib):
    done = returned(spark, (1, 2), V.HOAN_THANH, V.NGUYEN_VEN)
    assert rows(checks.restock_on_return(lib.chi_tiet, done), "them") == [(2,)]
    assert rows(checks.restock_on_return(lib.chi_tiet, done, "literal"), "them") == []
    damaged = returned(spark, (1, 2), V.DA_TRA, V.HONG)
    assert rows(checks.restock_on_return(lib.chi_tiet, damaged), "them") == []
    old = library_of(
        spark, chi_tiet=[{"ma_phieu_muon": 2, "ma_sach": 5, "trang_thai_muon": V.TRE_HEN}]
    ).chi_tiet
    assert rows(checks.restock_on_return(old, returned(spark, (1, 2), V.DA_TRA, V.TOT), "literal"), "them") == [(1,)]


def test_bulk_changes(spark, lib):
    slips = spark.createDataFrame([(1,), (2,), (2,)], "ma_phieu_muon bigint")
    change = batches.bulk_stock_decrement(lib, slips)
    assert rows(change, "ma_sach", "them") == [(5, -1), (100, -1), (101, -1), (102, -1), (103, -1)]
    setting = spark.createDataFrame(
        [(2, 5, V.DA_TRA, V.TOT), (9, 9, V.DA_TRA, V.TOT)],
        "ma_phieu_muon bigint, ma_sach bigint, trang_thai_muon string, trang_thai_sach string",
    )
    result = batches.bulk_status_set(lib, setting)
    assert rows(result.lines.where("ma_sach = 5"), "ma_phieu_muon", "trang_thai_muon") == [
        (2, V.DA_TRA), (3, V.DA_GIA_HAN)
    ]
    assert rows(checks.restock_on_return(result.before, result.after), "ma_sach", "them") == [(5, 1)]
