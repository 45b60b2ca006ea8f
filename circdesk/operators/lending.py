"""New loans: screen a batch of requests, settle the competing ones, write slips and lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from circdesk.functions.dates import moment, plus_days
from circdesk.functions.reasons import Check, fill, first_failing
from circdesk.model import messages as M
from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators.admission import KEY, refused_requests
from circdesk.operators.checks import (
    demand_per_book,
    with_statement,
    without_statements,
)
from circdesk.operators.measures import AsOf, is_overdue, lines_per_card, stock_open4
from circdesk.operators.ordering import (
    BLOCK,
    REQUEST_ORDER,
    highest_id,
    in_blocks,
    number_chosen,
    totals_before,
)
from circdesk.operators.scratch import durable
from circdesk.operators.skew import spread_join

BOOK, CARD = "sach", "the"
AFTER_BOOKS = 1_000_000  # the card limit is looked at after every book of the list


@dataclass(frozen=True)
class Loans:
    outcome: DataFrame  # with ma_phieu_muon of the new slip
    slips: DataFrame  # new phieu_muon rows
    lines: DataFrame  # new chi_tiet rows


def _card_facts(tables: Tables, as_of: AsOf) -> DataFrame:
    """One row per card: status, expiry, debt and books on loan, joined before any request is.

    Debt and books on loan come from one pass over the open lines.
    """
    per_slip = (
        tables.chi_tiet.where(F.col("trang_thai_muon").isin(*V.OPEN))
        .groupBy("ma_phieu_muon")
        .agg(
            F.coalesce(F.bool_or(is_overdue(as_of)), F.lit(False)).alias("_no"),
            F.count_if(F.col("trang_thai_muon") == V.DANG_MUON).alias("dang_muon"),
        )
        .where(F.col("_no") | (F.col("dang_muon") > 0))
    )
    per_card = (
        tables.phieu_muon.select("ma_phieu_muon", "ma_the")
        .join(per_slip, "ma_phieu_muon")
        .groupBy("ma_the")
        .agg(F.bool_or("_no").alias("_no"), F.sum("dang_muon").alias("dang_muon"))
    )
    return tables.the_thu_vien.select(
        "ma_the", F.col("trang_thai").alias("_tt_the"), "ngay_het_han", F.lit(True).alias("_co_the")
    ).join(per_card, "ma_the", "left")


def _request_checks(as_of: AsOf) -> list[Check]:
    days, count, items = F.col("so_ngay_muon"), F.col("so_sach"), F.col("_ma")
    return [
        Check("card_not_found", F.col("_co_the").isNull(), M.CARD_UNKNOWN),
        Check(
            "card_not_active",
            F.col("_tt_the") != V.HOAT_DONG,
            fill(M.CARD_INACTIVE, "_tt_the"),
        ),
        Check("card_expired", F.col("ngay_het_han") < moment(as_of), M.CARD_EXPIRED),
        Check(
            "overdue_debt",
            F.col("_no"),
            M.IN_DEBT,
        ),
        Check(
            "term_too_long",
            days > V.MAX_LOAN_DAYS,
            M.TERM_TOO_LONG,
        ),
        Check("term_not_positive", days <= 0, M.TERM_NOT_POSITIVE),
        Check("bad_item", F.exists(items, lambda x: x.isNull()), M.BAD_ITEM),
        Check(
            "too_many_books",
            count > V.SLIP_LIMIT,
            M.TOO_MANY_BOOKS,
        ),
        Check("empty_list", count == 0, M.EMPTY_LIST),
        Check(
            "duplicate_book",
            F.size(F.array_distinct(items)) < F.size(items),
            M.DUPLICATE_BOOK,
        ),
    ]


def screen_requests(tables: Tables, requests: DataFrame, as_of: AsOf) -> DataFrame:
    """Checks that depend on the card and the request alone: ``ly_do`` is null when all pass."""
    if "so_ngay_muon" not in requests.columns:
        requests = requests.withColumn("so_ngay_muon", F.lit(V.DEFAULT_LOAN_DAYS))
    items = F.split("danh_sach_sach", ",")
    parsed = (
        spread_join(requests, _card_facts(tables, as_of), ["ma_the"], "left")
        .withColumn("_ma", F.transform(items, lambda x: F.trim(x).try_cast("bigint")))
        .withColumn("so_sach", F.coalesce(F.array_size("_ma"), F.lit(0)))
    )
    code, message = first_failing(_request_checks(as_of))
    return parsed.select(
        "request_id", "seq", *[c for c in requests.columns if c == BLOCK],
        "ma_the", "ma_nhan_vien", "so_ngay_muon", "so_sach", "_ma",
        F.coalesce("dang_muon", F.lit(0)).alias("dang_muon"),
        code.alias("ly_do"), message.alias("thong_bao"),
    )


def _book_facts(tables: Tables, so_luong_is: str) -> DataFrame:
    """One row per book with the number of copies that may still go out (null: no limit)."""
    if so_luong_is == "total":
        books = stock_open4(tables, also=["ten_sach"])
        room = F.col("so_luong_con_lai")
    elif so_luong_is == "on_shelf":
        books, room = tables.sach, F.col("so_luong").cast("bigint")
    else:
        raise ValueError(f"unknown meaning of stock: {so_luong_is}")
    return books.select(
        "ma_sach", "ten_sach", room.alias("suc_chua"), F.lit(True).alias("_co_sach")
    )


def _asked_books(screened: DataFrame, books: DataFrame) -> DataFrame:
    """One row per book of the requests that passed, in list order."""
    asked = (
        screened.where(F.col("ly_do").isNull())
        .select(
            *[c for c in screened.columns if c in ("request_id", "seq", BLOCK)],
            "ma_the", "so_sach", "dang_muon", F.posexplode("_ma").alias("vi_tri", "ma_sach"),
        )
    )
    return spread_join(asked, books, ["ma_sach"], "left")


def _book_checks(taken: Column) -> list[Check]:
    return [
        Check(
            "book_not_found",
            F.col("_co_sach").isNull(),
            fill(M.BOOK_UNKNOWN, "ma_sach"),
        ),
        Check(
            "out_of_stock",
            F.col("suc_chua") - taken <= 0,
            fill(M.BOOK_OUT, "ten_sach"),
        ),
    ]


def screen_loans(
    tables: Tables,
    requests: DataFrame,
    as_of: AsOf,
    so_luong_is: str = "total",
    limit: int = V.CARD_LIMIT,
) -> DataFrame:
    """Outcome of every request on its own, against the stored tables only."""
    screened = durable(screen_requests(tables, requests, as_of))
    asked = _asked_books(screened, _book_facts(tables, so_luong_is))
    code, message = first_failing(_book_checks(F.lit(0)))
    first = (
        asked.withColumns({"_code": code, "_text": message})
        .where(F.col("_code").isNotNull())
        .groupBy("request_id")
        .agg(F.min(F.struct("vi_tri", "_code", "_text")).alias("_first"))
    )
    over = F.col("dang_muon") + F.col("so_sach") > limit
    ly_do = F.coalesce("ly_do", "_first._code", F.when(over, "loan_limit"))
    text = F.coalesce("thong_bao", "_first._text", F.when(over, M.LOAN_LIMIT))
    return screened.join(first, "request_id", "left").select(
        "request_id", "seq", ly_do.isNull().alias("thanh_cong"), ly_do.alias("ly_do"),
        text.alias("thong_bao"),
    )


def create_loans(
    tables: Tables,
    requests: DataFrame,
    as_of: AsOf,
    so_luong_is: str = "total",
    limit: int = V.CARD_LIMIT,
) -> Loans:
    """Make slips and lines as if the requests came one after another in ``seq`` order.

    ``so_luong_is`` says what the stored stock means: ``total`` (open loans are subtracted) or
    ``on_shelf`` (already net of loans; null never rejects).
    """
    # Finding the ranges of the blocks reads the batch twice, so that comes before the joins.
    screened = durable(screen_requests(tables, in_blocks(requests), as_of))
    # At most ten books per passing request, so a window over one request is bounded.
    request = Window.partitionBy("request_id")
    has_copy = F.col("_co_sach") & F.coalesce(F.col("suc_chua") > 0, F.lit(True))
    alone_ok = F.coalesce(has_copy, F.lit(False)) & (
        F.col("dang_muon") + F.col("so_sach") <= limit
    )
    asked = durable(
        _asked_books(screened, _book_facts(tables, so_luong_is)).withColumn(
            "_ung_vien", F.min(alone_ok).over(request)
        )
    )
    book_claims = asked.select(
        "request_id", "seq", BLOCK, F.lit(BOOK).alias("loai"), F.col("ma_sach").alias("khoa"),
        F.lit(1).cast("bigint").alias("so_luong"), "suc_chua", "_ung_vien", "vi_tri", "ma_sach",
        "ten_sach", "_co_sach",
    )
    card_claims = asked.where(F.col("vi_tri") == 0).select(
        "request_id", "seq", BLOCK, F.lit(CARD).alias("loai"), F.col("ma_the").alias("khoa"),
        F.col("so_sach").cast("bigint").alias("so_luong"),
        (F.lit(limit) - F.col("dang_muon")).alias("suc_chua"), "_ung_vien",
        F.lit(AFTER_BOOKS).alias("vi_tri"),
    )
    claims = book_claims.unionByName(card_claims, allowMissingColumns=True)
    refused = refused_requests(claims.where(F.col("_ung_vien")))

    # What earlier accepted requests took from each key, for the reason of every refusal.
    settled_claims = claims.join(
        refused.withColumn("_tu_choi", F.lit(True)), "request_id", "left"
    ).withColumn(
        "_lay",
        F.when(F.col("_ung_vien") & F.col("_tu_choi").isNull(), F.col("so_luong")).otherwise(F.lit(0)),
    )
    seen = totals_before(settled_claims, KEY, ["_lay"])
    code, message = first_failing(_book_checks(F.col("_lay_before")))
    no_room = F.col("_lay_before") + F.col("so_luong") > F.col("suc_chua")
    on_card = F.col("loai") == CARD
    first = (
        seen.where(~F.col("_ung_vien") | F.col("_tu_choi"))
        .withColumn("_code", F.when(on_card & no_room, "loan_limit").when(~on_card, code))
        .withColumn("_text", F.when(on_card, M.LOAN_LIMIT).otherwise(message))
        .where(F.col("_code").isNotNull())
        .groupBy("request_id")
        .agg(F.min(F.struct("vi_tri", "_code", "_text")).alias("_first"))
    )
    settled = number_chosen(
        durable(
            screened.join(first, "request_id", "left")
            .withColumn("ly_do", F.coalesce("ly_do", "_first._code"))
            .withColumn("thong_bao", F.coalesce("thong_bao", "_first._text"))
            .drop("_first")
        ),
        F.col("ly_do").isNull(),
        highest_id(tables.phieu_muon, "ma_phieu_muon"),
        "ma_phieu_muon",
    )
    ok = F.col("ly_do").isNull()
    success = fill(M.LOAN_MADE, "ma_phieu_muon")
    now = moment(as_of)
    made = settled.where(ok)
    return Loans(
        outcome=settled.select(
            "request_id", "seq", ok.alias("thanh_cong"), "ly_do",
            F.when(ok, success).otherwise(F.col("thong_bao")).alias("thong_bao"), "ma_phieu_muon",
        ),
        slips=made.select(
            "ma_phieu_muon", now.alias("ngay_lap"), F.col("so_sach").alias("tong_so_sach_muon"),
            "ma_the", "ma_nhan_vien",
        ),
        lines=made.select(
            "ma_phieu_muon", F.explode("_ma").alias("ma_sach"),
            plus_days(now, F.col("so_ngay_muon")).alias("ngay_tra_du_kien"),
            F.lit(None).cast("timestamp_ntz").alias("ngay_tra_thuc_te"),
            F.lit(V.DANG_MUON).alias("trang_thai_muon"),
            F.lit(None).cast("string").alias("trang_thai_sach"),
        ),
    )


def admit_statements(
    tables: Tables, inserted: DataFrame, limit: int = V.CARD_LIMIT
) -> DataFrame:
    """New loan lines whose statements are taken one after another in ``statement_id`` order.

    The in-order twin of ``check_new_lines``: an accepted statement uses up shelf stock and card
    room for the later ones, so the stock never drops below zero within a batch. Gives the
    accepted rows.
    """
    rows = with_statement(inserted)
    slips = tables.phieu_muon.select("ma_phieu_muon", "ma_the")
    per_slip = rows.groupBy("statement_id", "ma_phieu_muon").agg(F.count("ma_sach").alias("so_luong"))
    on_card = (
        per_slip.join(slips, "ma_phieu_muon")
        .groupBy("statement_id", "ma_the")
        .agg(F.sum("so_luong").alias("so_luong"))
    )
    held = lines_per_card(tables, [V.DANG_MUON], "dang_muon")
    card_claims = spread_join(on_card, held, ["ma_the"], "left").select(
        "statement_id", F.lit(CARD).alias("loai"), F.col("ma_the").alias("khoa"), "so_luong",
        (F.lit(limit) - F.coalesce("dang_muon", F.lit(0))).alias("suc_chua"),
    ).where(F.col("khoa").isNotNull())
    stock = tables.sach.select("ma_sach", F.col("so_luong").cast("bigint").alias("suc_chua"))
    book_claims = demand_per_book(rows).join(stock, "ma_sach").select(
        "statement_id", F.lit(BOOK).alias("loai"), F.col("ma_sach").alias("khoa"),
        F.col("nhu_cau").alias("so_luong"), "suc_chua",
    )
    claims = book_claims.unionByName(card_claims).withColumns(
        {"request_id": F.col("statement_id"), "seq": F.col("statement_id")}
    )
    # The keys take part in the order of the blocks, so that a huge statement fills several.
    blocks = in_blocks(durable(claims), (*REQUEST_ORDER, *KEY))
    refused = refused_requests(blocks).withColumnRenamed("request_id", "statement_id")
    return without_statements(rows, refused)


__all__ = [
    "Loans", "admit_statements", "create_loans", "screen_loans", "screen_requests",
]
