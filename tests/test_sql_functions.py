"""The functions that SQL text can call: single keys, unknown keys, and calls over whole tables."""

from decimal import Decimal

import pytest

from circdesk.functions.sql import SCALAR, register_functions
from circdesk.model import vocab as V
from circdesk.operators import measures, reports
from circdesk.sources.library import library_of
from tests.conftest import NOW, day, rows
from tests.test_plans import plan_of

LUC = f"timestamp_ntz '{NOW}'"


@pytest.fixture(scope="module")
def lib(spark):
    tables = library_of(
        spark,
        sach=[{"ma_sach": k, "ten_sach": f"T{k}", "so_luong": n, "don_gia": Decimal("100000"), "ma_the_loai": k % 2}
              for k, n in ((1, 4), (2, None), (3, 1))],
        the_loai=[{"ma_the_loai": k} for k in (0, 1, 2)],
        tac_gia_sach=[{"ma_tac_gia": 9, "ma_sach": 1}, {"ma_tac_gia": 9, "ma_sach": 3}, {"ma_tac_gia": 8, "ma_sach": 77}],
        doc_gia=[{"ma_doc_gia": k, "ho_ten": f"R{k}"} for k in (1, 2, 3)],
        the_thu_vien=[{"ma_the": 10, "ma_doc_gia": 1}, {"ma_the": 11, "ma_doc_gia": 1}, {"ma_the": 12, "ma_doc_gia": 2}],
        phieu_muon=[{"ma_phieu_muon": 50, "ma_the": 10}, {"ma_phieu_muon": 51, "ma_the": 12}],
        chi_tiet=[
            {"ma_phieu_muon": 50, "ma_sach": 1, "trang_thai_muon": V.TRE_HAN, "ngay_tra_du_kien": day("2001-07-22")},
            {"ma_phieu_muon": 50, "ma_sach": 3, "trang_thai_muon": V.DA_GIA_HAN, "ngay_tra_du_kien": day("2001-08-09")},
            {"ma_phieu_muon": 51, "ma_sach": 1, "trang_thai_muon": V.DA_TRA, "ngay_tra_du_kien": day("2001-07-01"),
             "ngay_tra_thuc_te": day("2001-07-03"), "trang_thai_sach": V.HONG},
            {"ma_phieu_muon": 51, "ma_sach": 99, "trang_thai_muon": V.DANG_MUON, "ngay_tra_du_kien": day(NOW)},
        ],
    )
    register_functions(spark, tables, "k_")
    return tables


@pytest.mark.parametrize("call, want", [
    (f"the_no_qua_han(10, {LUC})", True), (f"the_no_qua_han(12, {LUC})", False), (f"the_no_qua_han(999, {LUC})", False),
    (f"the_no_qua_han(null, {LUC})", False), (f"doc_gia_no_qua_han(1, {LUC})", True), (f"doc_gia_no_qua_han(3, {LUC})", False),
    ("so_con_lai_bon_trang_thai(1)", 3), ("so_con_lai_bon_trang_thai(2)", 0), ("so_con_lai_bon_trang_thai(3)", 0),
    ("so_con_lai_bon_trang_thai(99)", 0), ("so_con_lai_hai_trang_thai(3)", 1), ("so_con_lai_hai_trang_thai(99)", -1),
    (f"tien_phat_thay_the(50, 1, '{V.TOT}', {LUC})", Decimal("200000.00")),
    (f"tien_phat_thay_the(50, 1, '{V.MAT}', {LUC})", Decimal("100000.00")),
    (f"tien_phat_thay_the(51, 1, '{V.HONG}', {LUC})", Decimal("140000.00")),
    (f"tien_phat_thay_the(50, 77, '{V.MAT}', {LUC})", Decimal("0.00")),
    (f"tien_phat_cong_don(50, 1, {LUC})", Decimal("50000.00")), (f"tien_phat_cong_don(51, 1, {LUC})", Decimal("30000.00")),
    (f"tien_phat_cong_don(51, 99, {LUC})", Decimal("0.00")), (f"tien_phat_cong_don(1, 1, {LUC})", Decimal("0.00")),
    ("so_sach_dang_giu(1)", 1), ("so_sach_dang_giu(2)", 1), ("so_sach_dang_giu(999)", 0),
    ("ten_doc_gia_cua_the(11)", "R1"), ("ten_doc_gia_cua_the(999)", None),
])
def test_single_calls(spark, lib, call, want):
    assert spark.sql(f"SELECT k_{call}").first()[0] == want


def test_table_functions(spark, lib):
    assert rows(spark.sql("SELECT * FROM k_sach_cua_tac_gia(9)"), "ma_sach") == [(1,), (3,)]
    assert rows(spark.sql("SELECT * FROM k_sach_cua_the_loai(0)"), "ma_sach", "ten_sach") == [(2, "T2")]
    found = spark.sql(f"SELECT g.ma_doc_gia, f.* FROM k_doc_gia g, LATERAL k_sach_qua_han_cua_doc_gia(g.ma_doc_gia, {LUC}) f")
    columns = ["ma_doc_gia", "ma_phieu_muon", "ma_sach", "ten_sach", "ngay_tra_du_kien"]
    assert rows(found, *columns) == rows(reports.overdue_books_of_reader(lib, NOW), *columns) != []
    # readers without such books come too with an outer call
    outer = spark.sql(
        f"SELECT g.ma_doc_gia, f.ma_sach FROM k_doc_gia g LEFT JOIN LATERAL k_sach_qua_han_cua_doc_gia(g.ma_doc_gia, {LUC}) f")
    assert rows(outer, "ma_doc_gia", "ma_sach") == [(1, 1), (2, None), (3, None)]


def test_a_call_over_many_keys_is_a_join(spark, lib):
    """No subquery is left in the plan, and the lines are aggregated once for all keys."""
    plan = plan_of(spark.sql(f"SELECT ma_the, k_the_no_qua_han(ma_the, {LUC}) FROM k_the_thu_vien"))
    assert "Subquery" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
    plan = plan_of(spark.sql("SELECT ma_sach, k_so_con_lai_hai_trang_thai(ma_sach) FROM k_sach"))
    assert "Subquery" not in plan and "NestedLoop" not in plan and "partial_count" in plan


def test_functions_combine_with_sql(spark, lib):
    found = spark.sql(
        f"SELECT t.ma_doc_gia, sum(k_tien_phat_cong_don(c.ma_phieu_muon, c.ma_sach, {LUC})) AS phat "
        "FROM k_chi_tiet c JOIN k_phieu_muon p USING (ma_phieu_muon) JOIN k_the_thu_vien t USING (ma_the) "
        f"WHERE k_the_no_qua_han(t.ma_the, {LUC}) GROUP BY 1")
    assert rows(found, "ma_doc_gia", "phat") == [(1, Decimal("50000.00"))]
    plain = measures.overdue_debt(lib, NOW)
    by_sql = spark.sql(f"SELECT ma_the, k_the_no_qua_han(ma_the, {LUC}) AS co_no_qua_han FROM k_the_thu_vien")
    assert rows(by_sql, "ma_the", "co_no_qua_han") == rows(plain, "ma_the", "co_no_qua_han")


def test_registering_again_leaves_old_queries(spark, lib):
    register_functions(spark, lib, "m_")
    old = spark.sql("SELECT ma_sach, m_so_con_lai_hai_trang_thai(ma_sach) AS n FROM m_sach")
    before = rows(old, "ma_sach", "n")
    register_functions(spark, lib.having(chi_tiet=lib.chi_tiet.limit(0)), "m_")
    assert rows(old, "ma_sach", "n") == before
    new = spark.sql("SELECT ma_sach, m_so_con_lai_hai_trang_thai(ma_sach) AS n FROM m_sach")
    assert rows(new, "ma_sach", "n") == [(1, 4), (2, 0), (3, 1)] != before


def test_words_are_quoted_as_they_are():
    assert not any("'" in w for w in (*V.OPEN, *V.HELD, *V.LOST, *V.DAMAGED)) and SCALAR
