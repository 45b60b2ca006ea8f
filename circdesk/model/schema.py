"""Column names and Spark types of the eleven library tables."""

from __future__ import annotations

from pyspark.sql import types as T

_PERSON = (
    "ho_ten string, ngay_sinh timestamp_ntz, dia_chi string, cccd string, "
    "so_dien_thoai string, username string, password string, trang_thai string"
)

DDL: dict[str, str] = {
    "the_loai": "ma_the_loai bigint, ten_the_loai string, mo_ta string",
    "tac_gia": "ma_tac_gia bigint, ten_tac_gia string, mo_ta string",
    "sach": (
        "ma_sach bigint, ten_sach string, hinh_anh string, mo_ta string, nha_xuat_ban string, "
        "so_luong int, don_gia decimal(10,2), ma_the_loai bigint"
    ),
    "tac_gia_sach": "ma_tac_gia bigint, ma_sach bigint",
    "nhan_vien": f"ma_nhan_vien bigint, {_PERSON}",
    "doc_gia": f"ma_doc_gia bigint, {_PERSON}",
    "the_thu_vien": "ma_the bigint, ngay_het_han timestamp_ntz, trang_thai string, ma_doc_gia bigint",
    "phieu_muon": (
        "ma_phieu_muon bigint, ngay_lap timestamp_ntz, tong_so_sach_muon int, ma_the bigint, "
        "ma_nhan_vien bigint"
    ),
    "chi_tiet": (
        "ma_phieu_muon bigint, ma_sach bigint, ngay_tra_du_kien timestamp_ntz, "
        "ngay_tra_thuc_te timestamp_ntz, trang_thai_muon string, trang_thai_sach string"
    ),
    "hoa_don": (
        "ma_hoa_don bigint, ngay_lap timestamp_ntz, so_tien decimal(18,2), noi_dung string, "
        "ma_doc_gia bigint, ma_nhan_vien bigint"
    ),
    "yeu_cau_gia_han": (
        "ma_yeu_cau bigint, ma_phieu_muon bigint, ma_sach bigint, ngay_tao timestamp_ntz, "
        "ngay_gia_han timestamp_ntz, trang_thai string"
    ),
}

KEYS: dict[str, tuple[str, ...]] = {
    "the_loai": ("ma_the_loai",),
    "tac_gia": ("ma_tac_gia",),
    "sach": ("ma_sach",),
    "tac_gia_sach": ("ma_tac_gia", "ma_sach"),
    "nhan_vien": ("ma_nhan_vien",),
    "doc_gia": ("ma_doc_gia",),
    "the_thu_vien": ("ma_the",),
    "phieu_muon": ("ma_phieu_muon",),
    "chi_tiet": ("ma_phieu_muon", "ma_sach"),
    "hoa_don": ("ma_hoa_don",),
    "yeu_cau_gia_han": ("ma_yeu_cau",),
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def columns(table: str) -> list[str]:
    return schema(table).names
