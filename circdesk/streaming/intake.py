"""Circulation requests arriving as a stream.

Each micro-batch is handled by the ordinary batch job against the newest release, and its table
changes and outcomes become the next release. All state lives in the tables and in the counts kept
with them, so there is no watermark and no state store: a batch that comes late or is cut otherwise
meets what was accepted before it, as a single batch in that order would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from circdesk.model.tables import Tables
from circdesk.model.vocab import CARD_LIMIT
from circdesk.operators.batches import (
    apply_extensions,
    cancel_cards,
    decide_extensions,
    patch_accounts,
    process_returns,
)
from circdesk.operators.checks import check_card, with_statement
from circdesk.operators.deltas import add_to_stock
from circdesk.operators.in_order import admit_extensions, admit_readers
from circdesk.operators.lending import admit_statements, create_loans
from circdesk.operators.measures import AsOf
from circdesk.operators.ordering import highest_id, in_blocks, number_chosen
from circdesk.operators.scratch import durable
from circdesk.sources.versions import (
    Changes,
    Step,
    Update,
    current_release,
    is_published,
    publish,
    read_release,
)

Clock = AsOf | Callable[[], AsOf]


def _now(clock: Clock) -> AsOf:
    return clock() if callable(clock) else clock


def loans_step(as_of: Clock, so_luong_is: str = "total") -> Step:
    """New slips and lines; shelf stock also goes down when it is kept net of loans.

    ``as_of`` is one moment, or a function that is asked for the moment of every batch.
    """

    def step(tables: Tables, requests: DataFrame) -> Changes:
        made = create_loans(tables, requests, _now(as_of), so_luong_is)
        updated = {}
        if so_luong_is == "on_shelf":
            taken = made.lines.groupBy("ma_sach").count().selectExpr("ma_sach", "-count AS them")
            updated["sach"] = _stock(tables, taken)
        return Changes({"phieu_muon": made.slips, "chi_tiet": made.lines}, updated, outcome=made.outcome)

    return step


def returns_step(as_of: Clock, so_luong_is: str = "total", vocab: str = "canonical") -> Step:
    """Closed lines and invoices; shelf stock also goes up when it is kept net of loans."""

    def step(tables: Tables, requests: DataFrame) -> Changes:
        done = process_returns(tables, requests, _now(as_of), vocab)
        updated = {"chi_tiet": Update(
            done.line_changes, ["ngay_tra_thuc_te", "trang_thai_muon", "trang_thai_sach"])}
        if so_luong_is == "on_shelf":
            updated["sach"] = _stock(tables, done.stock_change)
        return Changes({"hoa_don": done.invoices}, updated, outcome=done.outcome)

    return step


def extensions_step() -> Step:
    """New due dates and statuses of lines whose approved extension is applied."""

    def step(tables: Tables, requests: DataFrame) -> Changes:
        done = apply_extensions(tables, requests)
        lines = Update(done.line_changes, ["ngay_tra_du_kien", "trang_thai_muon"])
        return Changes(updated={"chi_tiet": lines}, outcome=done.outcome)

    return step


def decisions_step() -> Step:
    """Decided extension requests, and the due dates that approvals move."""

    def step(tables: Tables, decisions: DataFrame) -> Changes:
        done = decide_extensions(tables, decisions)
        return Changes(updated={
            "yeu_cau_gia_han": Update(done.request_changes, ["trang_thai"]),
            "chi_tiet": Update(done.due_changes, ["ngay_tra_du_kien"]),
        }, outcome=done.outcome)

    return step


def accounts_step() -> Step:
    """Patched passwords and statuses of staff and readers."""

    def step(tables: Tables, patches: DataFrame) -> Changes:
        done, sets = patch_accounts(tables, patches), ["password", "trang_thai"]
        return Changes(updated={
            "nhan_vien": Update(done.staff_changes, sets), "doc_gia": Update(done.reader_changes, sets),
        }, outcome=done.outcome)

    return step


def cancellations_step() -> Step:
    """Cancelled cards and the readers that lose them."""

    def step(tables: Tables, requests: DataFrame) -> Changes:
        done = cancel_cards(tables, requests)
        return Changes(updated={
            "the_thu_vien": Update(done.card_changes, ["trang_thai"]), "doc_gia": Update(done.reader_changes, ["trang_thai"]),
        }, outcome=done.outcome)

    return step


def new_lines_step(limit: int = CARD_LIMIT) -> Step:
    """New loan lines by statement: stock and card room are used up in order, and the shelf stock goes down.

    What a card holds comes from the counts kept with the release, so no stored line is read.
    """

    def step(tables: Tables, rows: DataFrame) -> Changes:
        rows = durable(with_statement(rows))
        accepted = durable(admit_statements(tables, rows, limit))
        taken = accepted.groupBy("ma_sach").agg((-F.count("ma_sach")).alias("them"))
        return Changes({"chi_tiet": accepted}, {"sach": _stock(tables, taken)}, outcome=_verdicts(rows, accepted))

    return step


def new_slips_step(as_of: Clock) -> Step:
    """New slips by statement, on cards that are valid at the moment of the batch."""

    def step(tables: Tables, rows: DataFrame) -> Changes:
        rows = durable(with_statement(rows))
        accepted = durable(check_card(tables, rows, _now(as_of)).accepted)
        return Changes({"phieu_muon": accepted}, outcome=_verdicts(rows, accepted))

    return step


def new_requests_step() -> Step:
    """New extension requests by statement, one for a line; new ones are numbered after the stored ones."""

    def step(tables: Tables, rows: DataFrame) -> Changes:
        rows = durable(with_statement(rows))
        accepted = in_blocks(admit_extensions(tables, rows), ("statement_id", "ma_phieu_muon", "ma_sach"))
        numbered = number_chosen(
            accepted, F.lit(True), highest_id(tables.yeu_cau_gia_han, "ma_yeu_cau"), "ma_yeu_cau",
            ("statement_id", "ma_phieu_muon", "ma_sach"))
        return Changes({"yeu_cau_gia_han": durable(numbered)}, outcome=_verdicts(rows, accepted))

    return step


def new_readers_step() -> Step:
    """New readers by statement, whose identity number and phone nobody has."""

    def step(tables: Tables, rows: DataFrame) -> Changes:
        rows = durable(with_statement(rows))
        accepted = durable(admit_readers(tables, rows))
        return Changes({"doc_gia": accepted}, outcome=_verdicts(rows, accepted))

    return step


def _verdicts(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """statement_id and whether it was accepted."""
    both = rows.select("statement_id", F.lit(False).alias("_ok")).unionByName(
        accepted.select("statement_id", F.lit(True).alias("_ok")))
    return both.groupBy("statement_id").agg(F.max("_ok").alias("thanh_cong"))


def _stock(tables: Tables, per_book: DataFrame) -> Update:
    books = tables.sach.join(per_book.select("ma_sach"), "ma_sach", "left_semi")
    return Update(durable(add_to_stock(books, per_book).select("ma_sach", "so_luong")), ["so_luong"])


def run_step(
    spark: SparkSession, base: str, step: Step, requests: DataFrame, source: str | None = None
) -> int:
    """One batch against the newest release."""
    before = current_release(spark, base)
    return publish(spark, base, step(read_release(spark, base), requests), source, before)


def intake(requests: DataFrame, base: str, step: Step, name: str) -> DataStreamWriter:
    """A streaming writer that runs ``step`` on every micro-batch of ``requests``.

    A micro-batch that is replayed after a failure is recognised and not applied again: by
    ``name``, its number, and the id of the query, which lives in the checkpoint. A query with a new
    checkpoint has a new id, so its batches are new ones, whatever numbers they have.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        source = f"{name}:{query}:{epoch}"
        if not is_published(spark, base, source) and not batch.isEmpty():
            run_step(spark, base, step, batch, source)

    return requests.writeStream.queryName(name).foreachBatch(handle)
