"""Admission checks on batches of new or changed rows.

A batch carries ``statement_id``; one offending row rejects its whole statement. Without the
column the batch is a single statement. Each statement is checked against the stored tables;
``circdesk.operators.admission`` settles statements that compete for the same stock or card.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circdesk.functions.dates import moment
from circdesk.model import messages as M
from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators.deltas import add_to_stock
from circdesk.operators.measures import AsOf, lines_per_card
from circdesk.operators.skew import few_per_key, spread_join


@dataclass(frozen=True)
class Checked:
    """Rows of the statements that passed, and one row per offending key of the others."""

    accepted: DataFrame
    violations: DataFrame


@dataclass(frozen=True)
class StockChecked(Checked):
    stock_change: DataFrame  # ma_sach, them


def with_statement(rows: DataFrame) -> DataFrame:
    if "statement_id" in rows.columns:
        return rows
    return rows.withColumn("statement_id", F.lit(0).cast("bigint"))


def without_statements(rows: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows whose statement has no violation; one statement may hold most of either side."""
    return rows.join(few_per_key(violations, ["statement_id"]), "statement_id", "left_anti")


def _checked(rows: DataFrame, violations: DataFrame) -> Checked:
    return Checked(without_statements(rows, violations), violations)


def demand_per_book(rows: DataFrame) -> DataFrame:
    return rows.groupBy("statement_id", "ma_sach").agg(F.count("ma_sach").alias("nhu_cau"))


def check_stock(tables: Tables, inserted: DataFrame) -> StockChecked:
    """Reject statements that ask for more copies of a book than its stock.

    Unknown books and null stock pass. ``stock_change`` takes the accepted demand off the shelf.
    """
    rows = with_statement(inserted)
    demand = demand_per_book(rows)
    short = (
        demand.join(tables.sach.select("ma_sach", "so_luong"), "ma_sach")
        .where(F.col("so_luong") < F.col("nhu_cau"))
        .select(
            "statement_id", "ma_sach", "nhu_cau",
            F.col("so_luong").cast("bigint").alias("so_luong"), F.lit(M.NOT_ENOUGH_STOCK).alias("thong_bao"),
        )
    )
    accepted = without_statements(rows, short)
    change = accepted.groupBy("ma_sach").agg((-F.count("ma_sach")).alias("them"))
    return StockChecked(accepted, short, change)


def stock_after(tables: Tables, change: DataFrame) -> DataFrame:
    return add_to_stock(tables.sach, change)


def restock_on_return(
    before: DataFrame, after: DataFrame, vocab: str = "canonical"
) -> DataFrame:
    """Copies that come back to the shelf after lines changed: ``ma_sach, them``.

    ``before`` and ``after`` are the old and new versions of the changed lines. ``literal`` keeps
    the exact words of the studied rule; ``canonical`` takes every open status to every closed
    one, with both spellings of late and of a good condition.
    """
    old, new, good = _return_words(vocab)
    was_open = before.where(F.col("trang_thai_muon").isin(*old)).select("ma_phieu_muon", "ma_sach")
    returned = with_statement(after).where(
        F.col("trang_thai_muon").isin(*new) & F.col("trang_thai_sach").isin(*good)
    )
    return copies_back(
        returned.select("statement_id", "ma_phieu_muon", "ma_sach").join(
            was_open, ["ma_phieu_muon", "ma_sach"], "left_semi"
        )
    )


def restock_of_changes(changed: DataFrame, vocab: str = "canonical") -> DataFrame:
    """The same for rows that already hold the old status next to the new one (``trang_thai_cu``)."""
    old, new, good = _return_words(vocab)
    return copies_back(
        changed.where(
            F.col("trang_thai_cu").isin(*old)
            & F.col("trang_thai_muon").isin(*new)
            & F.col("trang_thai_sach").isin(*good)
        )
    )


def copies_back(returned: DataFrame) -> DataFrame:
    """A statement changes each book once, however many of its lines come back together."""
    return (
        returned.select("statement_id", "ma_sach")
        .distinct()
        .groupBy("ma_sach")
        .agg(F.count(F.lit(1)).alias("them"))
    )


def _return_words(vocab: str) -> tuple[Sequence[str], Sequence[str], Sequence[str]]:
    if vocab == "literal":
        return (V.DANG_MUON, V.TRE_HEN), (V.DA_TRA,), (V.TOT,)
    if vocab == "canonical":
        return (*V.OPEN, V.TRE_HEN), V.CLOSED, V.GOOD
    raise ValueError(f"unknown vocabulary: {vocab}")


def check_card(tables: Tables, inserted: DataFrame, as_of: AsOf) -> Checked:
    """Reject slips on expired or inactive cards; unknown cards and null facts pass."""
    rows = with_statement(inserted)
    expired = F.col("ngay_het_han") < moment(as_of)
    inactive = F.col("trang_thai") != V.HOAT_DONG
    refused = tables.the_thu_vien.where(expired | inactive).select(
        "ma_the",
        F.when(expired, "card_expired").otherwise("card_not_active").alias("ly_do"),
    )
    violations = (
        rows.select("statement_id", "ma_the")
        .distinct()
        .join(refused, "ma_the")
        .select("statement_id", "ma_the", "ly_do", F.lit(M.CARD_REFUSED).alias("thong_bao"))
    )
    return _checked(rows, violations)


def check_loan_limit(
    tables: Tables, inserted: DataFrame, limit: int = V.CARD_LIMIT
) -> Checked:
    """Reject statements that bring a card above ``limit`` books on loan. Unknown slips are ignored."""
    rows = with_statement(inserted)
    per_slip = rows.groupBy("statement_id", "ma_phieu_muon").agg(F.count("ma_sach").alias("_n"))
    per_card = (
        per_slip.join(tables.phieu_muon.select("ma_phieu_muon", "ma_the"), "ma_phieu_muon")
        .groupBy("statement_id", "ma_the")
        .agg(F.sum("_n").alias("muon_moi"))
    )
    held = lines_per_card(tables, [V.DANG_MUON], "dang_muon")
    over = (
        spread_join(per_card, held, ["ma_the"], "left")
        .withColumn("dang_muon", F.coalesce("dang_muon", F.lit(0)))
        .where(F.col("muon_moi") + F.col("dang_muon") > limit)
        .select(
            "statement_id", "ma_the", "muon_moi", "dang_muon", F.lit(M.LOAN_LIMIT).alias("thong_bao")
        )
    )
    return _checked(rows, over)


def check_single_extension(
    tables: Tables, inserted: DataFrame, strict: bool = False
) -> Checked:
    """Reject requests for a line that already has one, whatever came of it.

    Repeats inside the batch pass as in the studied rule; ``strict`` refuses every statement that
    shares a line with another request of the batch.
    """
    rows = with_statement(inserted)
    line = ["ma_phieu_muon", "ma_sach"]
    asked = rows.groupBy("statement_id", *line).agg(F.count(F.lit(1)).alias("_n"))
    stored = few_per_key(tables.yeu_cau_gia_han.select("ma_yeu_cau", *line), line)
    offending = asked.join(stored, line, "left_semi").select(
        "statement_id", *line, F.lit("already_requested").alias("ly_do")
    )
    if strict:
        repeated = (
            asked.groupBy(*line)
            .agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_all") > 1)
            .drop("_all")
        )
        in_batch = spread_join(asked, repeated, line, "left_semi", counted="_rows").select(
            "statement_id", *line, F.lit("repeated_in_batch").alias("ly_do")
        )
        offending = offending.unionByName(in_batch)
    return _checked(rows, offending.withColumn("thong_bao", F.lit(M.ONE_EXTENSION)))


UNIQUE = ("cccd", "so_dien_thoai")


def identifiers(people: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per non-null identity number or phone of a person: (cot, gia_tri)."""
    pairs = [F.struct(F.lit(c).alias("cot"), F.col(c).alias("gia_tri")) for c in UNIQUE]
    return (
        people.select(*keep, F.explode(F.array(*pairs)).alias("_id"))
        .select(*keep, "_id.cot", "_id.gia_tri")
        .where(F.col("gia_tri").isNotNull())
    )


def check_unique(
    existing: DataFrame, key: str, rows: DataFrame, strict: bool = False, own_key: bool = False
) -> Checked:
    """Both identity columns in one equi join on (column, value) instead of a join with an OR.

    For updates (``own_key``), an owner other than the row itself is looked for. ``existing`` needs the
    key and the two columns only.
    """
    rows = with_statement(rows)
    pair = ["cot", "gia_tri"]
    asked = identifiers(rows, ["statement_id", key])
    stored = identifiers(existing, [key])
    if own_key:
        owners = stored.groupBy(*pair, F.expr(f"pmod(xxhash64(`{key}`), 16)").alias("_part")).agg(
            F.min(key).alias("_low"), F.max(key).alias("_high")
        )
        a, o = asked.alias("a"), owners.alias("o")
        someone_else = (F.col("o._low") != F.col(f"a.{key}")) | (F.col("o._high") != F.col(f"a.{key}"))
        hits = a.join(
            o,
            (F.col("a.cot") == F.col("o.cot"))
            & (F.col("a.gia_tri") == F.col("o.gia_tri"))
            & someone_else,
            "left_semi",
        )
    else:
        hits = asked.join(few_per_key(stored, pair), pair, "left_semi")
    violations = hits.select("statement_id", key, *pair, F.lit("exists").alias("ly_do"))
    if strict:
        repeated = asked.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        in_batch = spread_join(asked, repeated, pair, "left_semi", counted="_n").select(
            "statement_id", key, *pair, F.lit("repeated_in_batch").alias("ly_do")
        )
        violations = violations.unionByName(in_batch)
    return _checked(rows, violations.withColumn("thong_bao", F.lit(M.PERSON_EXISTS)))


def check_unique_reader(tables: Tables, inserted: DataFrame, strict: bool = False) -> Checked:
    """Reject new readers whose identity number or phone another reader has; nulls never match."""
    return check_unique(tables.doc_gia, "ma_doc_gia", inserted, strict, own_key=False)


def check_unique_staff(tables: Tables, inserted: DataFrame, strict: bool = False) -> Checked:
    """The same rule among staff."""
    return check_unique(tables.nhan_vien, "ma_nhan_vien", inserted, strict, own_key=False)


def check_unique_reader_update(tables: Tables, changed: DataFrame) -> Checked:
    """The rule for changed readers: a row may keep its own values. Known from the requirements."""
    return check_unique(tables.doc_gia, "ma_doc_gia", changed, False, own_key=True)


def check_unique_staff_update(tables: Tables, changed: DataFrame) -> Checked:
    return check_unique(tables.nhan_vien, "ma_nhan_vien", changed, False, own_key=True)


def check_book_delete(tables: Tables, deleted: DataFrame) -> Checked:
    """Refuse to delete books with lines on loan. Known from the requirements."""
    rows = with_statement(deleted)
    busy = tables.chi_tiet.where(F.col("trang_thai_muon") == V.DANG_MUON).select(
        "ma_phieu_muon", "ma_sach"
    )
    violations = (
        rows.select("statement_id", "ma_sach")
        .distinct()
        .join(few_per_key(busy, ["ma_sach"]), "ma_sach", "left_semi")
        .withColumn("thong_bao", F.lit(M.BOOK_ON_LOAN))
    )
    return _checked(rows, violations)


def check_new_lines(
    tables: Tables, inserted: DataFrame, limit: int = V.CARD_LIMIT
) -> StockChecked:
    """Stock and card limit together: a statement is in only if it passes both."""
    rows = with_statement(inserted)
    stock = check_stock(tables, rows).violations.select(
        "statement_id", F.lit("out_of_stock").alias("ly_do"), F.col("ma_sach").alias("khoa"),
        "thong_bao",
    )
    cards = check_loan_limit(tables, rows, limit).violations.select(
        "statement_id", F.lit("loan_limit").alias("ly_do"), F.col("ma_the").alias("khoa"),
        "thong_bao",
    )
    violations = stock.unionByName(cards)
    accepted = without_statements(rows, violations)
    change = accepted.groupBy("ma_sach").agg((-F.count("ma_sach")).alias("them"))
    return StockChecked(accepted, violations, change)
