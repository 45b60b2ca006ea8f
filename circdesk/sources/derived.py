"""Library tables derived from the order tables under a scale-factor folder.

Parts become books, customers readers with one card each, orders loan slips and order lines loan
lines. Every row of the source tables takes part. The expressions have an SQL twin in
``circdesk.plans.oracle``.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators.scratch import durable

AS_OF = "2001-08-01 00:00:00"
LINE_ID_SPAN = 1_000_000_000  # line id = slip id * span + book id
LINE_ID = f"ma_phieu_muon * {LINE_ID_SPAN} + ma_sach"
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

_RAW = {
    "customer": "c_custkey bigint, c_name string, c_acctbal double",
    "events": "event_id bigint, user_id bigint, event_type string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string"
    ),
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "supplier": "s_suppkey bigint, s_name string",
}
_NO_TEXT = "cast(null as string)"
_CATEGORY = (
    "cast(case p_type "
    + " ".join(f"when '{name}' then {i}" for i, name in enumerate(CATEGORIES, start=1))
    + " end as bigint)"
)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_RAW[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _exprs(*texts: str) -> list[Column]:
    return [F.expr(t) for t in texts]


def _person(key: str, name: str, id_base: int, phone_base: int, login: str) -> list[str]:
    return [
        f"{name} as ho_ten",
        "cast(null as timestamp_ntz) as ngay_sinh",
        f"{_NO_TEXT} as dia_chi",
        f"cast(cast({key} as bigint) + {id_base} as string) as cccd",
        f"cast(cast({key} as bigint) + {phone_base} as string) as so_dien_thoai",
        f"concat('{login}', {key}) as username",
        f"concat('h', {key}) as password",
        f"'{V.HOAT_DONG}' as trang_thai",
    ]


def loan_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One line per (order, part). Grouped before the join, so a huge order spreads over its parts.

    The one-letter flags are compared by code: minima of numbers stay in the hash aggregate,
    minima of strings would sort.
    """
    grouped = lineitem.groupBy("l_orderkey", "l_partkey").agg(
        *_exprs(
            "min(l_linenumber) as ln",
            "min(cast(l_quantity as int)) as q",
            "min(ascii(l_returnflag)) as rf",
            "min(ascii(l_linestatus)) as ls",
            "min(cast(round(l_discount * 100) as int)) as di",
            "min(cast(round(l_tax * 100) as int)) as tx",
        )
    )
    dated = grouped.join(
        orders.selectExpr("o_orderkey as l_orderkey", "o_orderdate"), "l_orderkey"
    ).selectExpr(
        "*",
        "o_orderdate + interval '14' day as due",
        "rf = ascii('N') and ls = ascii('O') and "
        "(o_orderdate >= timestamp_ntz '2001-01-01 00:00:00' or q = 50) as is_open",
    )
    return dated.selectExpr(
        "l_orderkey as ma_phieu_muon",
        "l_partkey as ma_sach",
        "due as ngay_tra_du_kien",
        "case when not is_open then o_orderdate + make_dt_interval(q) end as ngay_tra_thuc_te",
        f"""case when is_open and ln = 7 then '{V.DAT_TRUOC}'
                 when is_open and ln = 3 then '{V.DA_GIA_HAN}'
                 when is_open and due < timestamp_ntz '{AS_OF}' and ln % 2 = 1 then '{V.TRE_HAN}'
                 when is_open then '{V.DANG_MUON}'
                 when q <= 14 and ls = ascii('F') then '{V.HOAN_THANH}'
                 when q <= 14 then '{V.DA_TRA}'
                 when q = 16 and di = 10 then '{V.TRE_HAN}'
                 else '{V.TRA_TRE}' end as trang_thai_muon""",
        f"""case when is_open then null
                 when di = 10 and tx = 8 then '{V.MAT}'
                 when di = 10 then '{V.HONG}'
                 else '{V.TOT}' end as trang_thai_sach""",
    )


def extension_requests(chi_tiet: DataFrame) -> DataFrame:
    """A request for every line still open or returned late."""
    return chi_tiet.where(
        f"ngay_tra_thuc_te is null or trang_thai_muon = '{V.TRA_TRE}'"
    ).selectExpr(
        f"{LINE_ID} as ma_yeu_cau",
        "ma_phieu_muon",
        "ma_sach",
        f"""case when ngay_tra_thuc_te is null
                 then timestamp_ntz '{AS_OF}' - make_dt_interval(cast(ma_sach % 8 as int))
                 else ngay_tra_du_kien - make_dt_interval(cast(ma_sach % 15 as int))
            end as ngay_tao""",
        "ngay_tra_du_kien + interval '14' day as ngay_gia_han",
        f"""case (ma_phieu_muon + ma_sach) % 3 when 0 then '{V.CHO}' when 1 then '{V.DA_DUYET}'
            else '{V.TU_CHOI}' end as trang_thai""",
    )


def derived_library(spark: SparkSession, sf_dir: str, written: bool = False) -> Tables:
    """The library over a folder. ``written`` writes the lines on first use, for queries that read them several times."""

    @cache
    def source(name: str) -> DataFrame:
        return raw(spark, sf_dir, name)

    @cache
    def chi_tiet() -> DataFrame:
        lines = loan_lines(source("lineitem"), source("orders"))
        return durable(lines) if written else lines

    def phieu_muon() -> DataFrame:
        counts = chi_tiet().groupBy("ma_phieu_muon").agg(*_exprs("count(1) as n"))
        slips = source("orders").withColumnRenamed("o_orderkey", "ma_phieu_muon")
        return slips.join(counts, "ma_phieu_muon", "left").selectExpr(
            "ma_phieu_muon",
            "o_orderdate as ngay_lap",
            "cast(coalesce(n, 0) as int) as tong_so_sach_muon",
            "o_custkey as ma_the",
            "ma_phieu_muon % 25 as ma_nhan_vien",
        )

    return Tables(
        the_loai=lambda: source("part").select("p_type").distinct().selectExpr(
            f"{_CATEGORY} as ma_the_loai", "p_type as ten_the_loai", f"{_NO_TEXT} as mo_ta"
        ),
        sach=lambda: source("part").selectExpr(
            "p_partkey as ma_sach",
            "p_name as ten_sach",
            f"{_NO_TEXT} as hinh_anh",
            f"{_NO_TEXT} as mo_ta",
            "p_brand as nha_xuat_ban",
            "p_size % 4 as so_luong",
            "cast(p_retailprice as decimal(10,2)) as don_gia",
            f"{_CATEGORY} as ma_the_loai",
        ),
        tac_gia=lambda: source("supplier").selectExpr(
            "s_suppkey as ma_tac_gia", "s_name as ten_tac_gia", f"{_NO_TEXT} as mo_ta"
        ),
        tac_gia_sach=lambda: source("lineitem").selectExpr(
            "l_suppkey as ma_tac_gia", "l_partkey as ma_sach"
        ).distinct(),
        nhan_vien=lambda: source("nation").selectExpr(
            "cast(n_nationkey as bigint) as ma_nhan_vien",
            *_person("n_nationkey", "n_name", 1_000_000_000, 8_000_000_000, "nv"),
        ),
        doc_gia=lambda: source("customer").selectExpr(
            "c_custkey as ma_doc_gia",
            *_person("c_custkey", "c_name", 2_000_000_000, 9_000_000_000, "dg"),
        ),
        the_thu_vien=lambda: source("customer").selectExpr(
            "c_custkey as ma_the",
            "timestamp_ntz '2001-07-01 00:00:00' + make_dt_interval(cast(c_custkey % 400 as int)) "
            "as ngay_het_han",
            f"if(c_acctbal < 0, '{V.BI_KHOA}', '{V.HOAT_DONG}') as trang_thai",
            "c_custkey as ma_doc_gia",
        ),
        phieu_muon=phieu_muon,
        chi_tiet=chi_tiet,
        hoa_don=lambda: source("orders").selectExpr(
            "o_orderkey as ma_hoa_don",
            "o_orderdate as ngay_lap",
            "cast(o_totalprice as decimal(18,2)) as so_tien",
            f"""case o_orderkey % 4 when 0 then '{V.TEXT_LATE}' when 1 then '{V.TEXT_LOST}'
                when 2 then '{V.TEXT_DAMAGED}' else '{V.TEXT_CARD}' end as noi_dung""",
            "o_custkey as ma_doc_gia",
            "o_orderkey % 25 as ma_nhan_vien",
        ),
        yeu_cau_gia_han=lambda: extension_requests(chi_tiet()),
    )
