from decimal import Decimal

import pytest

from circdesk.model import vocab as V
from circdesk.operators import reports
from circdesk.sources.library import library_of
from tests.conftest import NOW, day, rows

D = Decimal


@pytest.fixture(scope="module")
def lib(spark):
    return library_of(
        spark,
        the_loai=[{"ma_the_loai": 1, "ten_the_loai": "X"}, {"ma_the_loai": 2, "ten_the_loai": "Y"}],
        tac_gia_sach=[{"ma_tac_gia": 1, "ma_sach": 1}, {"ma_tac_gia": 2, "ma_sach": 1}],
        sach=[
            {"ma_sach": k, "ten_sach": f"B{k}", "so_luong": k, "ma_the_loai": 1, "don_gia": D(5)}
            for k in (1, 2, 3)
        ],
        doc_gia=[{"ma_doc_gia": 7, "ho_ten": "An", "so_dien_thoai": "09"}],
        the_thu_vien=[
            {"ma_the": 1, "ma_doc_gia": 7, "ngay_het_han": day("2001-07-31 23:00:00")},
            {"ma_the": 2, "ma_doc_gia": 7, "ngay_het_han": day(NOW)},
            {"ma_the": 3, "ma_doc_gia": 7, "ngay_het_han": day("2001-08-31 00:00:00")},
            {"ma_the": 4, "ma_doc_gia": 7, "ngay_het_han": day("2001-08-31 00:00:01")},
            {"ma_the": 5, "ma_doc_gia": 7, "ngay_het_han": None},
        ],
        phieu_muon=[{"ma_phieu_muon": 1, "ma_the": 1}, {"ma_phieu_muon": 2, "ma_the": 2}],
        chi_tiet=[
            {"ma_phieu_muon": 1, "ma_sach": 1, "ngay_tra_du_kien": day("2001-07-22"),
             "trang_thai_muon": V.DANG_MUON},
            {"ma_phieu_muon": 1, "ma_sach": 2, "ngay_tra_thuc_te": day("2001-03-31"),
             "trang_thai_muon": V.DA_TRA, "trang_thai_sach": V.HU_HONG_NANG},
            {"ma_phieu_muon": 2, "ma_sach": 1, "ngay_tra_thuc_te": day("2001-02-01"),
             "trang_thai_muon": V.DA_TRA, "trang_thai_sach": V.MAT},
        ],
        hoa_don=[
            {"ma_hoa_don": 1, "ngay_lap": day("2001-02-28 10:00:00"), "so_tien": D("1.50"),
             "noi_dung": V.TEXT_LATE + " (3 ngày) - Mã phiếu: 1, Mã sách: 1"},
            {"ma_hoa_don": 2, "ngay_lap": day("2001-03-01"), "so_tien": D("2.00"),
             "noi_dung": V.TEXT_CARD},
            {"ma_hoa_don": 3, "ngay_lap": day("2001-03-31 23:59:59"), "so_tien": D("4.00"),
             "noi_dung": "Khác"},
        ],
        yeu_cau_gia_han=[
            {"ma_yeu_cau": 1, "ma_phieu_muon": 1, "ma_sach": 1}, {"ma_yeu_cau": 2, "ma_phieu_muon": 9, "ma_sach": 9},
        ],
    )


def test_fine_report_keeps_the_three_statuses(lib):
    found = rows(reports.fine_report(lib, NOW), "ma_phieu_muon", "ma_sach", "ten_doc_gia", "tien_phat")
    assert found == [(1, 1, "An", D(0)), (1, 2, "An", D(0)), (2, 1, "An", D("5.00"))]
    by_value = rows(reports.fine_report(lib, NOW, "replacement"), "ma_phieu_muon", "ma_sach", "tien_phat")
    assert by_value == [(1, 1, D(200000)), (1, 2, D(5)), (2, 1, D(5))]


def test_expired_cards_and_their_text(lib):
    found = rows(reports.expired_card_notice(lib, NOW), "ma_the", "so_ngay_qua_han", "thong_bao")
    assert found == [(1, 1, "Độc giả 7 (Mã thẻ 1) đã quá hạn 1 ngày")]


def test_cards_expiring_includes_both_ends(lib):
    assert rows(reports.cards_expiring(lib, NOW), "ma_the") == [(2,), (3,)]


def test_income_by_source_and_month(lib):
    assert rows(reports.classify_income(lib, "2001-03"), "nguon_thu", "tong_tien") == [
        ("khac", D(4)), ("lam_the", D(2))
    ]
    assert len(reports.classify_income(lib).collect()) == 3


def test_revenue_periods(lib):
    assert [str(r[0]) for r in rows(reports.revenue_by_period(lib, "month"), "ky")] == [
        "2001-02-01", "2001-03-01"
    ]
    assert rows(reports.revenue_by_period(lib, "quarter"), "doanh_thu") == [(D("7.50"),)]
    assert len(reports.revenue_by_period(lib, "day").collect()) == 3


def test_category_status_has_no_fan_out(lib):
    found = rows(
        reports.category_status(lib),
        "ma_the_loai", "tong_so_luong", "dang_muon", "con_lai", "hu_hong",
    )
    assert found == [(1, 6, 1, 5, 1), (2, 0, 0, 0, 0)]


def test_damage_ratio_counts_lost_apart(lib):
    assert rows(reports.damage_ratio(lib, "year"), "so_tra", "so_hong", "so_mat", "ty_le_hong") == [
        (2, 1, 1, 0.5)
    ]


def test_lookups_and_lists(lib):
    assert rows(reports.lookup(lib.sach, ma_sach=2), "ten_sach") == [("B2",)]
    assert rows(reports.requests_for_line(lib, 1, 1), "ma_yeu_cau") == [(1,)]
    assert rows(reports.requests_for_line(lib), "ma_yeu_cau") == [(1,)]
    assert rows(reports.borrowed_books(lib), "ma_sach") == [(1,), (2,)]
    assert rows(reports.loans_per_book(lib), "ma_sach", "so_luong_muon") == [(1, 2), (2, 1)]
    assert rows(reports.open_loans_per_card(lib), "ma_the", "so_sach") == [(1, 1)]
    assert rows(reports.books_by_author(lib, 2), "ma_sach", "ten_sach") == [(1, "B1")]
    assert rows(reports.books_by_category(lib, 1), "ma_sach") == [(1,), (2,), (3,)]
    assert rows(reports.reader_name_of_card(lib, 3), "ho_ten") == [("An",)]
    assert rows(reports.overdue_books_of_reader(lib, NOW, 7), "ma_phieu_muon", "ma_sach") == [(1, 1)]
    assert rows(reports.overdue_readers(lib, NOW), "ho_ten", "so_dien_thoai", "ma_sach", "so_ngay_tre") == [
        ("An", "09", 1, 10)
    ]
    top = [(r.ma_sach, r.so_luong_muon) for r in reports.top_books(lib, 1).collect()]
    assert top == [(1, 2)]
