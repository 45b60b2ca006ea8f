"""Reports, lookups and notices: read-only queries over the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circdesk.functions.dates import days_between, moment, period_start, plus_days
from circdesk.functions.fines import MONEY
from circdesk.functions.reasons import fill
from circdesk.model import messages as M
from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators.measures import (
    AsOf,
    additive_fine_of,
    is_overdue,
    lines_per_book,
    lines_per_card,
    reader_open_loans,
    replacement_fine_of,
    stock_open2,
)


def slip_readers(tables: Tables, *reader_columns: str) -> DataFrame:
    """Each slip with its reader: the small tables are joined first, the slips shuffle once."""
    readers = tables.doc_gia.select("ma_doc_gia", *reader_columns)
    holders = tables.the_thu_vien.select("ma_the", "ma_doc_gia").join(readers, "ma_doc_gia")
    return tables.phieu_muon.select("ma_phieu_muon", "ma_the").join(holders, "ma_the")


# -- reports and lookups with a counterpart in the studied scripts ------------


def fine_report(tables: Tables, as_of: AsOf, policy: str = "additive") -> DataFrame:
    """Reader, slip, book, statuses and fine of late, current and returned lines."""
    fine = {"additive": additive_fine_of, "replacement": replacement_fine_of}[policy](as_of)
    lines = tables.chi_tiet.where(F.col("trang_thai_muon").isin(*V.FINE_REPORT))
    return (
        lines.join(tables.sach.select("ma_sach", "ten_sach", "don_gia"), "ma_sach")
        .join(slip_readers(tables, "ho_ten"), "ma_phieu_muon")
        .select(
            "ma_doc_gia",
            F.col("ho_ten").alias("ten_doc_gia"),
            "ma_phieu_muon",
            "ma_sach",
            "ten_sach",
            "trang_thai_muon",
            "trang_thai_sach",
            fine.alias("tien_phat"),
        )
    )


def stock_report(tables: Tables) -> DataFrame:
    """Every book with its stock and what is left of it, never-borrowed books included."""
    return stock_open2(tables, also=["ten_sach", "so_luong"])


def reader_loan_report(tables: Tables) -> DataFrame:
    """Every reader with the number of books now held."""
    return reader_open_loans(tables, also=["ho_ten"])


def loans_per_book(tables: Tables) -> DataFrame:
    return tables.chi_tiet.groupBy("ma_sach").agg(F.count("ma_sach").alias("so_luong_muon"))


def borrowed_books(tables: Tables) -> DataFrame:
    """Books that appear in some loan line."""
    seen = tables.chi_tiet.select("ma_sach").distinct()
    return tables.sach.select("ma_sach").join(seen, "ma_sach", "left_semi").distinct()


def open_loans_per_card(tables: Tables) -> DataFrame:
    """Lines on loan per card, for cards that have any."""
    per_card = lines_per_card(tables, [V.DANG_MUON], "so_sach")
    return per_card.join(tables.the_thu_vien.select("ma_the"), "ma_the")


def requests_for_line(
    tables: Tables, ma_phieu_muon: int | None = None, ma_sach: int | None = None
) -> DataFrame:
    """Extension requests of one loan line, or of every line."""
    lines = tables.chi_tiet.select("ma_phieu_muon", "ma_sach")
    if ma_phieu_muon is not None:
        lines = lines.where(F.col("ma_phieu_muon") == ma_phieu_muon)
    if ma_sach is not None:
        lines = lines.where(F.col("ma_sach") == ma_sach)
    return tables.yeu_cau_gia_han.join(lines, ["ma_phieu_muon", "ma_sach"]).select(
        *tables.yeu_cau_gia_han.columns
    )


def lookup(table: DataFrame, **keys: object) -> DataFrame:
    """A whole table, or its rows with the given column values."""
    for column, value in keys.items():
        table = table.where(F.col(column) == F.lit(value))
    return table


# -- notices ------------------------------------------------------------------


def expired_card_notice(tables: Tables, as_of: AsOf) -> DataFrame:
    """Reader, card and days past expiry for cards expired before ``as_of``, with the text to send."""
    now = moment(as_of)
    expired = tables.the_thu_vien.where(F.col("ngay_het_han") < now).select(
        "ma_doc_gia", "ma_the", days_between(F.col("ngay_het_han"), now).alias("so_ngay_qua_han")
    )
    message = fill(M.CARD_NOTICE, "ma_doc_gia", "ma_the", "so_ngay_qua_han")
    readers = tables.doc_gia.select("ma_doc_gia")
    return expired.join(readers, "ma_doc_gia").withColumn("thong_bao", message)


def rarely_borrowed_notice(tables: Tables, threshold: int = 2) -> DataFrame:
    """Books borrowed fewer than ``threshold`` times, never-borrowed ones included."""
    counts = tables.chi_tiet.groupBy("ma_sach").agg(
        F.count("ma_phieu_muon").alias("so_lan_muon")
    )
    message = fill(M.BOOK_NOTICE, "ten_sach", "ma_sach", "so_lan_muon")
    return (
        tables.sach.select("ma_sach", "ten_sach")
        .join(counts, "ma_sach", "left")
        .withColumn("so_lan_muon", F.coalesce("so_lan_muon", F.lit(0)))
        .where(F.col("so_lan_muon") < threshold)
        .withColumn("thong_bao", message)
    )


# -- reports known only from the requirements ---------------------------------


def books_by_author(tables: Tables, ma_tac_gia: int | None = None) -> DataFrame:
    """Books of one author, or author-book pairs for all."""
    links = lookup(tables.tac_gia_sach, **_given(ma_tac_gia=ma_tac_gia))
    return links.join(tables.sach.select("ma_sach", "ten_sach"), "ma_sach").select(
        "ma_tac_gia", "ma_sach", "ten_sach"
    )


def books_by_category(tables: Tables, ma_the_loai: int | None = None) -> DataFrame:
    """Books of one category, or every book with its category."""
    books = lookup(tables.sach, **_given(ma_the_loai=ma_the_loai))
    return books.select("ma_the_loai", "ma_sach", "ten_sach")


def overdue_books_of_reader(
    tables: Tables, as_of: AsOf, ma_doc_gia: int | None = None
) -> DataFrame:
    """Overdue unreturned lines of one reader, or of all readers."""
    overdue = tables.chi_tiet.where(is_overdue(as_of)).select(
        "ma_phieu_muon", "ma_sach", "ngay_tra_du_kien"
    )
    cards = lookup(tables.the_thu_vien, **_given(ma_doc_gia=ma_doc_gia))
    slips = tables.phieu_muon.select("ma_phieu_muon", "ma_the").join(
        cards.select("ma_the", "ma_doc_gia"), "ma_the"
    )
    return (
        overdue.join(slips, "ma_phieu_muon")
        .join(tables.sach.select("ma_sach", "ten_sach"), "ma_sach")
        .select("ma_doc_gia", "ma_phieu_muon", "ma_sach", "ten_sach", "ngay_tra_du_kien")
    )


def reader_name_of_card(tables: Tables, ma_the: int | None = None) -> DataFrame:
    cards = lookup(tables.the_thu_vien, **_given(ma_the=ma_the))
    return (
        cards.select("ma_the", "ma_doc_gia")
        .join(tables.doc_gia.select("ma_doc_gia", "ho_ten"), "ma_doc_gia")
        .select("ma_the", "ho_ten")
    )


def classify_income(tables: Tables, month: str | None = None) -> DataFrame:
    """Invoices per month by source: fines, card fees (both by text prefix) and the rest."""
    text = F.col("noi_dung")
    is_fine = text.startswith(V.FINE_TEXTS[0])
    for prefix in V.FINE_TEXTS[1:]:
        is_fine = is_fine | text.startswith(prefix)
    source = (
        F.when(is_fine, "phat").when(text.startswith(V.TEXT_CARD), "lam_the").otherwise("khac")
    )
    invoices = tables.hoa_don
    if month is not None:  # a plain range on the stored column, so it reaches the scan
        first = moment(f"{month}-01 00:00:00")
        invoices = invoices.where(
            (F.col("ngay_lap") >= first)
            & (F.col("ngay_lap") < first + F.make_ym_interval(F.lit(0), F.lit(1)))
        )
    return (
        invoices.groupBy(
            period_start(F.col("ngay_lap"), "month").alias("thang"), source.alias("nguon_thu")
        )
        .agg(
            F.count(F.lit(1)).alias("so_hoa_don"),
            F.sum("so_tien").cast(MONEY).alias("tong_tien"),
        )
    )


def top_books(tables: Tables, n: int = 10) -> DataFrame:
    """The ``n`` most borrowed books; ties go to the lower id."""
    return (
        loans_per_book(tables)
        .join(tables.sach.select("ma_sach", "ten_sach"), "ma_sach")
        .orderBy(F.desc("so_luong_muon"), "ma_sach")
        .limit(n)
        .select("ma_sach", "ten_sach", "so_luong_muon")
    )


def overdue_readers(tables: Tables, as_of: AsOf) -> DataFrame:
    """Readers with overdue books, one row per book so that no reader becomes one huge row."""
    now = moment(as_of)
    overdue = tables.chi_tiet.where(is_overdue(as_of)).select(
        "ma_phieu_muon", "ma_sach", days_between(F.col("ngay_tra_du_kien"), now).alias("so_ngay_tre")
    )
    return (
        overdue.join(slip_readers(tables, "ho_ten", "so_dien_thoai"), "ma_phieu_muon")
        .join(tables.sach.select("ma_sach", "ten_sach"), "ma_sach")
        .select(
            "ma_doc_gia", "ho_ten", "so_dien_thoai", "ma_phieu_muon", "ma_sach", "ten_sach",
            "so_ngay_tre",
        )
    )


def revenue_by_period(tables: Tables, unit: str = "month") -> DataFrame:
    """Invoice count and sum per day, month, quarter or year."""
    return tables.hoa_don.groupBy(period_start(F.col("ngay_lap"), unit).alias("ky")).agg(
        F.count(F.lit(1)).alias("so_hoa_don"), F.sum("so_tien").cast(MONEY).alias("doanh_thu")
    )


def category_status(tables: Tables) -> DataFrame:
    """Stock, on loan, left and damaged per category; lines are counted per book first."""
    is_open = F.col("trang_thai_muon").isin(*V.OPEN)
    is_damaged = F.col("trang_thai_sach").isin(*V.DAMAGED)
    per_book = (
        tables.chi_tiet.where(is_open | is_damaged)
        .groupBy("ma_sach")
        .agg(F.count_if(is_open).alias("_muon"), F.count_if(is_damaged).alias("_hong"))
    )
    per_category = (
        tables.sach.select("ma_sach", "ma_the_loai", "so_luong")
        .join(per_book, "ma_sach", "left")
        .groupBy("ma_the_loai")
        .agg(
            F.sum(F.col("so_luong").cast("bigint")).alias("tong_so_luong"),
            F.sum(F.coalesce("_muon", F.lit(0))).alias("dang_muon"),
            F.sum(F.coalesce("_hong", F.lit(0))).alias("hu_hong"),
        )
    )
    zero = F.lit(0).cast("bigint")
    stock, on_loan = F.coalesce("tong_so_luong", zero), F.coalesce("dang_muon", zero)
    return tables.the_loai.join(per_category, "ma_the_loai", "left").select(
        "ma_the_loai",
        "ten_the_loai",
        stock.alias("tong_so_luong"),
        on_loan.alias("dang_muon"),
        (stock - on_loan).alias("con_lai"),
        F.coalesce("hu_hong", zero).alias("hu_hong"),
    )


def damage_ratio(tables: Tables, unit: str = "month") -> DataFrame:
    """Damaged share of the books returned in each period; lost books are counted apart."""
    condition = F.col("trang_thai_sach")
    return (
        tables.chi_tiet.where(F.col("ngay_tra_thuc_te").isNotNull())
        .groupBy(period_start(F.col("ngay_tra_thuc_te"), unit).alias("ky"))
        .agg(
            F.count(F.lit(1)).alias("so_tra"),
            F.count_if(condition.isin(*V.DAMAGED)).alias("so_hong"),
            F.count_if(condition.isin(*V.LOST)).alias("so_mat"),
        )
        .withColumn("ty_le_hong", F.col("so_hong").cast("double") / F.col("so_tra").cast("double"))
    )


def cards_expiring(tables: Tables, as_of: AsOf, days: int = 30) -> DataFrame:
    """Cards that expire from ``as_of`` to ``days`` later, both ends included."""
    now = moment(as_of)
    return tables.the_thu_vien.where(
        F.col("ngay_het_han").between(now, plus_days(now, days))
    ).select("ma_the", "ma_doc_gia", "ngay_het_han", "trang_thai")


def _given(**values: object) -> dict[str, object]:
    return {k: v for k, v in values.items() if v is not None}


__all__ = [
    "books_by_author", "books_by_category", "borrowed_books", "cards_expiring", "category_status",
    "classify_income", "damage_ratio", "expired_card_notice", "fine_report", "lines_per_book",
    "loans_per_book", "lookup", "open_loans_per_card", "overdue_books_of_reader", "overdue_readers",
    "rarely_borrowed_notice", "reader_loan_report", "reader_name_of_card", "requests_for_line",
    "revenue_by_period", "slip_readers", "stock_report", "top_books",
]
