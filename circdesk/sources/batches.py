"""Request and insert batches derived from the same source tables as the library.

Every batch covers its whole source table. Their SQL twins are in ``circdesk.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.sources.derived import AS_OF, LINE_ID, raw

_NOW = f"timestamp_ntz '{AS_OF}'"
_CARD_OF_EVENT = "user_id * 10 + event_id % 11 as ma_the"


def _highest(spark: SparkSession, sf_dir: str, table: str, column: str) -> Column:
    """The largest key of a table as a scalar subquery."""
    return raw(spark, sf_dir, table).select(F.max(column)).scalar()


def loan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan request per event; a few with a bad term, list or item."""
    events = raw(spark, sf_dir, "events").withColumn(
        "n", _highest(spark, sf_dir, "part", "p_partkey")
    )
    books = events.selectExpr(
        "*",
        "cast(event_id % (n + 5) as string) as b1",
        "cast((event_id * 7) % (n + 1) as string) as b2",
    )
    return books.selectExpr(
        "event_id as request_id",
        "event_id as seq",
        _CARD_OF_EVENT,
        "event_id % 25 as ma_nhan_vien",
        """case when event_id % 83 = 0 then null
                when event_id % 79 = 0 then concat(b1, ',', b1)
                when event_id % 73 = 0 then concat(b1, ',', b2, ',x')
                when event_id % 71 = 0 then concat_ws(',', array_repeat(concat(b1, ',', b2), 6))
                else concat(b1, ',', b2) end as danh_sach_sach""",
        f"""case when event_id % 97 = 0 then 90 when event_id % 89 = 0 then 0
            else {V.DEFAULT_LOAN_DAYS} end as so_ngay_muon""",
    )


def return_requests(tables: Tables) -> DataFrame:
    """One return request per loan line, closed ones included."""
    return tables.chi_tiet.selectExpr(
        f"{LINE_ID} as request_id",
        f"{LINE_ID} as seq",
        "ma_phieu_muon",
        "ma_sach",
        f"""case ma_sach % 5 when 0 then '{V.TOT}' when 1 then '{V.NGUYEN_VEN}'
            when 2 then '{V.HONG}' when 3 then '{V.MAT}' else 'Ướt' end as trang_thai_sach""",
        "ma_sach % 25 as ma_nhan_vien",
    )


def _twice(tables: Tables) -> DataFrame:
    """Every stored extension request two times, told apart by ``lan``."""
    return tables.yeu_cau_gia_han.selectExpr("*", "explode(array(0, 1)) as lan")


def extension_applications(tables: Tables) -> DataFrame:
    """Two applications per stored request, the second one a repeat."""
    return _twice(tables).selectExpr(
        "ma_yeu_cau * 2 + lan as request_id", "ma_yeu_cau * 2 + lan as seq", "ma_yeu_cau"
    )


def extension_decisions(tables: Tables) -> DataFrame:
    """Two decisions per stored request, a third of them undecided."""
    return _twice(tables).selectExpr(
        "ma_yeu_cau * 2 + lan as request_id",
        "ma_yeu_cau * 2 + lan as seq",
        "ma_yeu_cau",
        """case (ma_phieu_muon + ma_sach * (lan + 1)) % 3 when 0 then true when 1 then false end
           as chap_nhan""",
    )


def account_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per event; errors patch staff logins (some unknown), the rest reader logins."""
    return raw(spark, sf_dir, "events").selectExpr(
        "event_id as request_id",
        "event_id as seq",
        """if(event_type = 'error', concat('nv', event_id % 30),
           concat('dg', user_id * 11 + event_id % 11)) as username""",
        "if(event_type in ('signup', 'error'), concat('p', event_id), null) as password_moi",
        f"""case when event_type in ('click', 'error')
            then if(event_id % 2 = 0, '{V.HOAT_DONG}', '{V.VO_HIEU}') end as trang_thai_moi""",
    )


def cancellation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer, for the next reader; the last reader does not exist."""
    return raw(spark, sf_dir, "customer").selectExpr(
        "c_custkey as request_id", "c_custkey as seq", "c_custkey + 1 as ma_doc_gia"
    )


def new_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new edition of every part; some with an unknown category, blank title or unknown author."""
    parts = raw(spark, sf_dir, "part").withColumn(
        "n", _highest(spark, sf_dir, "supplier", "s_suppkey")
    )
    return parts.selectExpr(
        "p_partkey as request_id",
        "p_partkey as seq",
        "if(p_size = 9, '  ', p_name) as ten_sach",
        "'img/bia.jpg' as hinh_anh",
        "p_type as mo_ta",
        "p_brand as nha_xuat_ban",
        "p_size - 3 as so_luong",
        "cast(p_retailprice - 905 as decimal(10,2)) as don_gia",
        "cast(p_size % 8 as bigint) as ma_the_loai",
        """case p_partkey % 6 when 0 then null
                when 1 then concat(p_partkey % (n + 9), ', ', p_name)
                when 2 then concat(p_name, ',', p_name, ' ,Supplier#000000001')
                else concat(p_name, ' ', p_type, ',0') end as danh_sach_tac_gia""",
    )


def inserted_lines(spark: SparkSession, sf_dir: str, per_statement: int = 1) -> DataFrame:
    """Two new loan lines per event; events are put into statements of ``per_statement``."""
    events = raw(spark, sf_dir, "events").withColumns(
        {
            "n": _highest(spark, sf_dir, "part", "p_partkey"),
            "m": _highest(spark, sf_dir, "orders", "o_orderkey"),
        }
    )
    return events.selectExpr(
        f"event_id div {per_statement} as statement_id",
        "(user_id * 97) % (m + 1) as ma_phieu_muon",
        "explode(array(event_id % (n + 5), (event_id * 7) % (n + 1))) as ma_sach",
        f"{_NOW} + make_dt_interval({V.DEFAULT_LOAN_DAYS}) as ngay_tra_du_kien",
        "cast(null as timestamp_ntz) as ngay_tra_thuc_te",
        f"'{V.DANG_MUON}' as trang_thai_muon",
        "cast(null as string) as trang_thai_sach",
    )


def inserted_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new slip per event, three to a statement."""
    return raw(spark, sf_dir, "events").selectExpr(
        "event_id div 3 as statement_id",
        "event_id as ma_phieu_muon",
        f"{_NOW} as ngay_lap",
        "1 as tong_so_sach_muon",
        _CARD_OF_EVENT,
        "event_id % 25 as ma_nhan_vien",
    )


def inserted_extensions(tables: Tables) -> DataFrame:
    """A new extension request for every loan line, one statement per slip."""
    return tables.chi_tiet.selectExpr(
        "ma_phieu_muon as statement_id",
        "ma_phieu_muon",
        "ma_sach",
        f"{_NOW} as ngay_tao",
        "ngay_tra_du_kien + interval '14' day as ngay_gia_han",
        f"'{V.CHO}' as trang_thai",
    )


def _people(table: DataFrame, key: str, shift: int, cccd: str, phone: str) -> DataFrame:
    return table.selectExpr(
        f"{key} as statement_id", f"{key} + {shift} as {key}", "ho_ten",
        f"cast({cccd} as string) as cccd", f"cast({phone} as string) as so_dien_thoai",
    )


def inserted_readers(tables: Tables) -> DataFrame:
    """A new reader per stored one; some share a stored identity number or phone."""
    return _people(
        tables.doc_gia, "ma_doc_gia", 1_000_000_000,
        "ma_doc_gia * 2 + 2000000000", "ma_doc_gia * 3 + 9000000000",
    )


def inserted_staff(tables: Tables) -> DataFrame:
    return _people(
        tables.nhan_vien, "ma_nhan_vien", 1_000_000,
        "ma_nhan_vien * 2 + 1000000000", "ma_nhan_vien * 3 + 8000000000",
    )


def changed_readers(tables: Tables) -> DataFrame:
    """Every reader keeps the identity number and takes a phone twice as far along."""
    return _people(tables.doc_gia, "ma_doc_gia", 0, "cccd", "ma_doc_gia * 2 + 9000000000")


def changed_staff(tables: Tables) -> DataFrame:
    return _people(tables.nhan_vien, "ma_nhan_vien", 0, "cccd", "ma_nhan_vien * 2 + 8000000000")


def returned_lines(tables: Tables) -> DataFrame:
    """Every loan line set to returned, in a state that depends on the book; one statement per slip."""
    return tables.chi_tiet.selectExpr(
        "ma_phieu_muon as statement_id",
        "ma_phieu_muon",
        "ma_sach",
        f"if(ma_sach % 2 = 0, '{V.DA_TRA}', '{V.HOAN_THANH}') as trang_thai_muon",
        f"""case ma_sach % 3 when 0 then '{V.TOT}' when 1 then '{V.NGUYEN_VEN}' else '{V.HONG}' end
            as trang_thai_sach""",
    )
