from decimal import Decimal

import pytest

from circdesk.model import vocab as V
from circdesk.operators import measures, reports
from circdesk.sources.library import library_of
from tests.conftest import NOW, day, rows

D = Decimal


def line(slip, book, due, returned=None, status=V.DANG_MUON, condition=None):
    return {
        "ma_phieu_muon": slip, "ma_sach": book, "ngay_tra_du_kien": day(due) if due else None,
        "ngay_tra_thuc_te": day(returned) if returned else None, "trang_thai_muon": status,
        "trang_thai_sach": condition,
    }


@pytest.fixture(scope="module")
def lib(spark):
    return library_of(
        spark,
        sach=[
            {"ma_sach": 1, "ten_sach": "A", "so_luong": 3, "don_gia": D("90.50")},
            {"ma_sach": 2, "ten_sach": "B", "so_luong": None, "don_gia": D("10.15")},
            {"ma_sach": 3, "ten_sach": "C", "so_luong": 5, "don_gia": None},
            {"ma_sach": 4, "ten_sach": "D", "so_luong": 2, "don_gia": D("7.00")},
        ],
        doc_gia=[{"ma_doc_gia": k, "ho_ten": f"R{k}"} for k in (1, 2, 3)],
        the_thu_vien=[
            {"ma_the": 10, "ma_doc_gia": 1}, {"ma_the": 11, "ma_doc_gia": 1},
            {"ma_the": 20, "ma_doc_gia": 2}, {"ma_the": 30, "ma_doc_gia": 3},
        ],
        phieu_muon=[
            {"ma_phieu_muon": s, "ma_the": c}
            for s, c in ((100, 10), (101, 11), (200, 20), (201, 20), (300, 30))
        ],
        chi_tiet=[
            line(100, 1, NOW),  # due exactly at as_of
            line(101, 1, "2001-07-31 23:59:59", status=V.DAT_TRUOC),
            line(200, 1, "2001-07-01 09:00:00", "2001-07-01 18:00:00", V.TRA_TRE, V.TOT),
            line(200, 2, "2001-07-01 23:59:00", "2001-07-02 00:01:00", V.TRE_HAN, V.TOT),
            line(201, 1, "2001-07-22", status=V.TRE_HAN, condition=V.MAT),
            line(201, 2, "2001-07-22", status=V.TRE_HAN, condition=V.HONG),
            line(201, 3, "2001-07-05", "2001-07-02", V.TRE_HAN, V.TOT),
            line(300, 3, "2001-07-05", "2001-07-02", V.HOAN_THANH, V.MAT),
            line(300, 99, "2001-09-01"),
            line(301, 99, "2001-09-01", status=V.TRE_HAN),
        ],
    )


def test_debt_is_strict_and_by_card_or_reader(spark, lib):
    assert rows(measures.overdue_debt(lib, NOW), "ma_the", "co_no_qua_han") == [
        (10, False), (11, True), (20, True), (30, False)
    ]
    assert rows(measures.overdue_debt(lib, NOW, by="reader"), "ma_doc_gia", "co_no_qua_han") == [
        (1, True), (2, True), (3, False)
    ]
    asked = spark.createDataFrame([(11,), (77,)], "ma_the bigint")
    assert rows(measures.overdue_debt(lib, NOW, keys=asked), "ma_the", "co_no_qua_han") == [
        (11, True), (77, False)
    ]


def test_stock_rules_differ_on_unknown_books_and_statuses(spark, lib):
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (99,)], "ma_sach bigint")
    assert rows(measures.stock_open4(lib, asked), "ma_sach", "so_luong_con_lai") == [
        (1, 0), (2, 0), (3, 4), (4, 2), (99, 0)
    ]
    assert rows(measures.stock_open2(lib, asked), "ma_sach", "so_luong_con_lai") == [
        (1, 1), (2, -2), (3, 4), (4, 2), (99, -2)
    ]
    assert rows(reports.stock_report(lib), "ma_sach", "so_luong", "so_luong_con_lai") == [
        (1, 3, 1), (2, None, -2), (3, 5, 4), (4, 2, 2)
    ]


def fines(df):
    return {(r.ma_phieu_muon, r.ma_sach): r.tien_phat for r in df.collect()}


def test_replacement_fine(lib):
    found = fines(measures.fine_replacement(lib, NOW))
    assert found[(100, 1)] == 0  # due at as_of
    assert found[(101, 1)] == 20000  # one midnight
    assert found[(200, 1)] == 0  # same day
    assert found[(200, 2)] == 20000
    assert found[(201, 1)] == D("90.50")  # lost: price only, though late
    assert found[(201, 2)] == D("200010.15")
    assert found[(201, 3)] == 0  # early
    assert found[(300, 3)] == 0  # null price, lost
    assert found[(300, 99)] == 0  # unknown book


def test_replacement_fine_for_asked_lines_and_conditions(spark, lib):
    asked = spark.createDataFrame(
        [(201, 2, V.MAT_SACH), (201, 2, V.NGUYEN_VEN), (5, 5, V.MAT), (300, 99, V.HONG)],
        "ma_phieu_muon bigint, ma_sach bigint, trang_thai_sach string",
    )
    found = rows(measures.fine_replacement(lib, NOW, asked), "ma_phieu_muon", "ma_sach", "tien_phat")
    assert found == [(5, 5, D(0)), (201, 2, D("10.15")), (201, 2, D(200000)), (300, 99, D(0))]


def test_additive_fine(lib):
    found = fines(measures.fine_additive(lib, NOW))
    assert found[(101, 1)] == 0  # not marked late
    assert found[(200, 2)] == 5000
    assert found[(201, 1)] == D("50090.50")
    assert found[(201, 2)] == D("50003.05")  # 3.045 rounds away from zero
    assert found[(201, 3)] == -15000
    assert found[(300, 3)] is None  # null price, lost
    assert found[(300, 99)] == 0


def test_reader_open_loans(spark, lib):
    assert rows(measures.reader_open_loans(lib), "ma_doc_gia", "so_sach_dang_muon") == [
        (1, 1), (2, 4), (3, 1)
    ]
    asked = spark.createDataFrame([(2,), (9,)], "ma_doc_gia bigint")
    assert rows(measures.reader_open_loans(lib, asked), "ma_doc_gia", "so_sach_dang_muon") == [
        (2, 4), (9, 0)
    ]


def test_never_borrowed_book_is_noticed(lib):
    found = rows(reports.rarely_borrowed_notice(lib), "ma_sach", "so_lan_muon", "thong_bao")
    assert found == [(4, 0, 'Sách "D" (Mã sách: 4) ít được mượn – Số lần mượn: 0')]


def test_unknown_choices_are_refused(lib):
    with pytest.raises(ValueError):
        measures.overdue_debt(lib, NOW, by="branch")
    with pytest.raises(ValueError):
        reports.revenue_by_period(lib, "decade")
    with pytest.raises(KeyError):
        reports.fine_report(lib, NOW, policy="none")
