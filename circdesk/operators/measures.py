"""Debt, stock, fines and open loans.

Counts are always taken per key before any join, so a book or card with a large share of the
loan lines is combined map-side and never travels as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circdesk.functions import fines
from circdesk.functions.dates import moment
from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators.skew import spread_join

AsOf = datetime | str


def is_overdue(as_of: AsOf) -> Column:
    """Open, not returned, and due strictly before ``as_of``."""
    return (
        F.col("trang_thai_muon").isin(*V.OPEN)
        & (F.col("ngay_tra_du_kien") < moment(as_of))
        & F.col("ngay_tra_thuc_te").isNull()
    )


def cards_in_debt(tables: Tables, as_of: AsOf) -> DataFrame:
    """Distinct ``ma_the`` with an overdue unreturned book."""
    slips = tables.chi_tiet.where(is_overdue(as_of)).select("ma_phieu_muon").distinct()
    return (
        tables.phieu_muon.select("ma_phieu_muon", "ma_the")
        .join(slips, "ma_phieu_muon")
        .select("ma_the")
        .distinct()
    )


def _keys_asked(table: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    """The caller's keys without repeats, or every key of the table."""
    return table.select(key) if keys is None else keys.select(key).distinct()


def _flag(keys: DataFrame, hits: DataFrame, key: str, name: str) -> DataFrame:
    flagged = hits.select(key, F.lit(True).alias(name))
    return keys.join(flagged, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def overdue_debt(
    tables: Tables, as_of: AsOf, by: str = "card", keys: DataFrame | None = None
) -> DataFrame:
    """Whether each card (or reader) holds an overdue unreturned book; unknown keys are false."""
    cards = cards_in_debt(tables, as_of)
    if by == "card":
        asked = _keys_asked(tables.the_thu_vien, keys, "ma_the")
        return _flag(asked, cards, "ma_the", "co_no_qua_han")
    if by != "reader":
        raise ValueError(f"unknown grouping: {by}")
    readers = (
        tables.the_thu_vien.select("ma_the", "ma_doc_gia")
        .join(cards, "ma_the")
        .select("ma_doc_gia")
        .distinct()
    )
    asked = _keys_asked(tables.doc_gia, keys, "ma_doc_gia")
    return _flag(asked, readers, "ma_doc_gia", "co_no_qua_han")


def lines_per_book(tables: Tables, statuses: Sequence[str], name: str) -> DataFrame:
    """Loan lines in the given statuses, counted per book, or taken from the kept-up count."""
    kept_up = tables.count_of("dem_sach")
    if kept_up is not None:
        return _added_up(kept_up, "ma_sach", statuses, name)
    return (
        tables.chi_tiet.where(F.col("trang_thai_muon").isin(*statuses))
        .groupBy("ma_sach")
        .agg(F.count(F.lit(1)).alias(name))
    )


def _added_up(counts: DataFrame, key: str, statuses: Sequence[str], name: str) -> DataFrame:
    wanted = counts.where(F.col("trang_thai_muon").isin(*statuses))
    return wanted.groupBy(key).agg(F.sum("so_dong").alias(name)).where(F.col(name) > 0)


def _stock(
    tables: Tables, statuses: Sequence[str], left: Column, keys: DataFrame | None, also: Sequence[str]
) -> DataFrame:
    on_loan = lines_per_book(tables, statuses, "_dang_muon")
    stock = tables.sach.select("ma_sach", F.col("so_luong").cast("bigint").alias("_tong"), *also)
    if keys is not None:
        stock = keys.select("ma_sach").distinct().join(stock, "ma_sach", "left")
    return stock.join(on_loan, "ma_sach", "left").select(
        "ma_sach", *also, left.alias("so_luong_con_lai")
    )


def stock_open4(
    tables: Tables, keys: DataFrame | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """Stock less lines in the four open statuses; unknown book or null stock gives 0.

    ``also`` names further book columns to keep, which spares a second read of the books.
    """
    zero = F.lit(0).cast("bigint")
    left = F.coalesce(F.col("_tong") - F.coalesce("_dang_muon", zero), zero)
    return _stock(tables, V.OPEN, left, keys, also)


def stock_open2(
    tables: Tables, keys: DataFrame | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """Stock less lines on loan or late; an unknown book counts as stock 0."""
    zero = F.lit(0).cast("bigint")
    left = F.coalesce("_tong", zero) - F.coalesce("_dang_muon", zero)
    return _stock(tables, V.HELD, left, keys, also)


def _lines_asked(tables: Tables, keys: DataFrame | None) -> DataFrame:
    """All lines, or the asked ones (null columns when unknown) with a condition of their own."""
    lines = tables.chi_tiet.withColumn("_co_dong", F.lit(True))
    if keys is None:
        return lines
    if "trang_thai_sach" in keys.columns:
        lines = lines.drop("trang_thai_sach")
    return spread_join(keys.distinct(), lines, ["ma_phieu_muon", "ma_sach"])


def _fine_rows(tables: Tables, lines: DataFrame, fine: Column) -> DataFrame:
    """One fine per line; 0 when the line or its book is unknown, whatever the condition."""
    prices = tables.sach.select("ma_sach", "don_gia", F.lit(True).alias("_co_sach"))
    amount = F.when(F.col("_co_dong") & F.col("_co_sach"), fine).otherwise(
        F.lit(0).cast(fines.MONEY)
    )
    return lines.join(prices, "ma_sach", "left").select(
        "ma_phieu_muon", "ma_sach", amount.alias("tien_phat")
    )


def replacement_fine_of(as_of: AsOf) -> Column:
    return fines.replacement_fine(
        F.col("ngay_tra_du_kien"),
        F.col("ngay_tra_thuc_te"),
        F.col("don_gia"),
        F.col("trang_thai_sach"),
        moment(as_of),
    )


def additive_fine_of(as_of: AsOf) -> Column:
    return fines.additive_fine(
        F.col("ngay_tra_du_kien"),
        F.col("ngay_tra_thuc_te"),
        F.col("don_gia"),
        F.col("trang_thai_muon"),
        F.col("trang_thai_sach"),
        moment(as_of),
    )


def fine_replacement(tables: Tables, as_of: AsOf, keys: DataFrame | None = None) -> DataFrame:
    """Policy 1 per loan line; ``keys`` may bring its own ``trang_thai_sach``."""
    return _fine_rows(tables, _lines_asked(tables, keys), replacement_fine_of(as_of))


def fine_additive(tables: Tables, as_of: AsOf, keys: DataFrame | None = None) -> DataFrame:
    """Policy 2 per loan line, always on the stored condition."""
    asked = keys.select("ma_phieu_muon", "ma_sach") if keys is not None else None
    return _fine_rows(tables, _lines_asked(tables, asked), additive_fine_of(as_of))


def lines_per_card(tables: Tables, statuses: Sequence[str], name: str) -> DataFrame:
    """Books in the given statuses, counted per card: first per slip, then over its slips.

    A kept-up count spares reading lines and slips.
    """
    kept_up = tables.count_of("dem_the")
    if kept_up is not None:
        return _added_up(kept_up, "ma_the", statuses, name)
    per_slip = (
        tables.chi_tiet.where(F.col("trang_thai_muon").isin(*statuses))
        .groupBy("ma_phieu_muon")
        .agg(F.count("ma_sach").alias("_n"))
    )
    return (
        tables.phieu_muon.select("ma_phieu_muon", "ma_the")
        .join(per_slip, "ma_phieu_muon")
        .groupBy("ma_the")
        .agg(F.sum("_n").alias(name))
    )


def reader_open_loans(
    tables: Tables, keys: DataFrame | None = None, also: Sequence[str] = ()
) -> DataFrame:
    """Books each reader now holds, over all their cards; 0 for none or for an unknown reader.

    ``also`` names further reader columns to keep when all readers are asked.
    """
    per_reader = (
        tables.the_thu_vien.select("ma_the", "ma_doc_gia")
        .join(lines_per_card(tables, V.HELD, "_n"), "ma_the")
        .groupBy("ma_doc_gia")
        .agg(F.sum("_n").alias("so_sach_dang_muon"))
    )
    asked = tables.doc_gia.select("ma_doc_gia", *also)
    if keys is not None:
        asked = keys.select("ma_doc_gia").distinct()
    return asked.join(per_reader, "ma_doc_gia", "left").withColumn(
        "so_sach_dang_muon", F.coalesce("so_sach_dang_muon", F.lit(0))
    )
