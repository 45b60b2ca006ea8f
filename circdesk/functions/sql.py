"""The computations as functions that SQL text can call.

Scalar functions take keys and give one value, table functions give rows and are called with
``LATERAL``. Their bodies are SQL over the library tables; a call in a query over many keys becomes
one aggregate and one join, not a query per row. Every function that depends on the date takes the
moment as an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from circdesk.functions.fines import MONEY
from circdesk.model import vocab as V
from circdesk.model.tables import Tables


def _words(words: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_UNRETURNED = f"c.trang_thai_muon IN {_words(V.OPEN)} AND c.ngay_tra_thuc_te IS NULL"
_LINE = "struct<den_han: timestamp_ntz, tra: timestamp_ntz, muon: string, sach: string, gia: decimal(10,2)>"
_LATE = "coalesce(greatest(datediff(coalesce(dong.tra, luc), dong.den_han), 0), 0)"

# name -> (parameters, result, body); {x} stands for the name of view or function x.
# A subquery looks rows up by key alone, and what depends on the moment is worked out around it: then
# a call over many keys is an aggregate and a join.
SCALAR: dict[str, tuple[str, str, str]] = {
    "han_som_nhat_cua_the": (
        "ma bigint", "timestamp_ntz",
        "(SELECT min(c.ngay_tra_du_kien) FROM {chi_tiet} c JOIN {phieu_muon} p ON p.ma_phieu_muon = c.ma_phieu_muon "
        f"WHERE p.ma_the = ma AND {_UNRETURNED})",
    ),
    "han_som_nhat_cua_doc_gia": (
        "ma bigint", "timestamp_ntz",
        "(SELECT min(c.ngay_tra_du_kien) FROM {chi_tiet} c JOIN {phieu_muon} p ON p.ma_phieu_muon = c.ma_phieu_muon "
        f"JOIN {{the_thu_vien}} t ON t.ma_the = p.ma_the WHERE t.ma_doc_gia = ma AND {_UNRETURNED})",
    ),
    "the_no_qua_han": (
        "ma bigint, luc timestamp_ntz", "boolean", "coalesce({han_som_nhat_cua_the}(ma) < luc, false)",
    ),
    "doc_gia_no_qua_han": (
        "ma bigint, luc timestamp_ntz", "boolean", "coalesce({han_som_nhat_cua_doc_gia}(ma) < luc, false)",
    ),
    "so_con_lai_bon_trang_thai": (
        "ma bigint", "bigint",
        "coalesce((SELECT max(cast(s.so_luong AS bigint)) FROM {sach} s WHERE s.ma_sach = ma) - "
        f"(SELECT count(*) FROM {{chi_tiet}} c WHERE c.ma_sach = ma AND c.trang_thai_muon IN {_words(V.OPEN)}), 0L)",
    ),
    "so_con_lai_hai_trang_thai": (
        "ma bigint", "bigint",
        "coalesce((SELECT max(cast(s.so_luong AS bigint)) FROM {sach} s WHERE s.ma_sach = ma), 0L) - "
        f"(SELECT count(*) FROM {{chi_tiet}} c WHERE c.ma_sach = ma AND c.trang_thai_muon IN {_words(V.HELD)})",
    ),
    "dong_muon": (
        "phieu bigint, quyen bigint", _LINE,
        "(SELECT max(struct(c.ngay_tra_du_kien AS den_han, c.ngay_tra_thuc_te AS tra, c.trang_thai_muon AS muon, "
        "c.trang_thai_sach AS sach, s.don_gia AS gia)) FROM {chi_tiet} c JOIN {sach} s ON s.ma_sach = c.ma_sach "
        "WHERE c.ma_phieu_muon = phieu AND c.ma_sach = quyen)",
    ),
    "muc_phat_thay_the": (
        f"dong {_LINE}, tinh_trang string, luc timestamp_ntz", MONEY,
        f"""cast(CASE WHEN dong IS NULL THEN 0
                 WHEN tinh_trang IN {_words(V.LOST)} THEN coalesce(dong.gia, 0)
                 WHEN tinh_trang IN {_words(V.DAMAGED)} THEN coalesce(dong.gia, 0) + {_LATE} * {V.REPLACEMENT_DAILY}
                 ELSE {_LATE} * {V.REPLACEMENT_DAILY} END AS {MONEY})""",
    ),
    "muc_phat_cong_don": (
        f"dong {_LINE}, luc timestamp_ntz", MONEY,
        f"""cast(CASE WHEN dong IS NULL THEN 0 ELSE
                 CASE WHEN dong.muon = '{V.TRE_HAN}'
                      THEN datediff(coalesce(dong.tra, luc), dong.den_han) * {V.ADDITIVE_DAILY} ELSE 0 END
                 + CASE dong.sach WHEN '{V.HONG}' THEN dong.gia * {V.ADDITIVE_DAMAGE_SHARE}
                                  WHEN '{V.MAT}' THEN dong.gia ELSE 0 END END AS {MONEY})""",
    ),
    "tien_phat_thay_the": (
        "phieu bigint, quyen bigint, tinh_trang string, luc timestamp_ntz", MONEY,
        "{muc_phat_thay_the}({dong_muon}(phieu, quyen), tinh_trang, luc)",
    ),
    "tien_phat_cong_don": (
        "phieu bigint, quyen bigint, luc timestamp_ntz", MONEY, "{muc_phat_cong_don}({dong_muon}(phieu, quyen), luc)",
    ),
    "so_sach_dang_giu": (
        "ma bigint", "bigint",
        "(SELECT count(c.ma_sach) FROM {chi_tiet} c JOIN {phieu_muon} p ON p.ma_phieu_muon = c.ma_phieu_muon "
        "JOIN {the_thu_vien} t ON t.ma_the = p.ma_the "
        f"WHERE t.ma_doc_gia = ma AND c.trang_thai_muon IN {_words(V.HELD)})",
    ),
    "ten_doc_gia_cua_the": (
        "ma bigint", "string",
        "(SELECT max(g.ho_ten) FROM {the_thu_vien} t JOIN {doc_gia} g ON g.ma_doc_gia = t.ma_doc_gia WHERE t.ma_the = ma)",
    ),
}

TABLE: dict[str, tuple[str, str, str]] = {
    "sach_cua_tac_gia": (
        "ma bigint", "ma_sach bigint, ten_sach string",
        "SELECT s.ma_sach, s.ten_sach FROM {tac_gia_sach} l JOIN {sach} s ON s.ma_sach = l.ma_sach WHERE l.ma_tac_gia = ma",
    ),
    "sach_cua_the_loai": (
        "ma bigint", "ma_sach bigint, ten_sach string",
        "SELECT s.ma_sach, s.ten_sach FROM {sach} s WHERE s.ma_the_loai = ma",
    ),
    "sach_qua_han_cua_doc_gia": (
        "ma bigint, luc timestamp_ntz",
        "ma_phieu_muon bigint, ma_sach bigint, ten_sach string, ngay_tra_du_kien timestamp_ntz",
        "SELECT c.ma_phieu_muon, c.ma_sach, s.ten_sach, c.ngay_tra_du_kien FROM {chi_tiet} c "
        "JOIN {phieu_muon} p ON p.ma_phieu_muon = c.ma_phieu_muon JOIN {the_thu_vien} t ON t.ma_the = p.ma_the "
        f"JOIN {{sach}} s ON s.ma_sach = c.ma_sach WHERE t.ma_doc_gia = ma AND {_UNRETURNED} AND c.ngay_tra_du_kien < luc",
    ),
}


def register_functions(spark: SparkSession, tables: Tables, prefix: str = "") -> None:
    """Make the tables temporary views and the functions temporary functions of the session.

    All names begin with ``prefix``, so that several libraries can be open side by side. Registering
    again replaces them; queries that were set up before keep what they had.
    """
    views = {name: f"{prefix}{name}" for name in (*Tables.names(), *SCALAR)}
    for name in Tables.names():
        getattr(tables, name).createOrReplaceTempView(views[name])
    for name, (parameters, result, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} "
                  f"RETURN {body.format(**views)}")
    for name, (parameters, result, body) in TABLE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({result}) "
                  f"RETURN {body.format(**views)}")
