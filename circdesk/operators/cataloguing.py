"""New books with their authors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circdesk.functions.reasons import Check, fill, first_failing
from circdesk.model import messages as M
from circdesk.model.schema import columns
from circdesk.model.tables import Tables
from circdesk.operators.ordering import REQUEST_ORDER, highest_id, in_blocks, number_chosen
from circdesk.operators.scratch import durable
from circdesk.operators.skew import spread_join

AUTHOR_ID = r"^[+-]?[0-9]+$"
PLACE = (*REQUEST_ORDER, "vi_tri")


@dataclass(frozen=True)
class NewBooks:
    outcome: DataFrame  # with ma_sach
    books: DataFrame  # new sach rows
    authors: DataFrame  # new tac_gia rows
    links: DataFrame  # new tac_gia_sach rows


def _checks() -> list[Check]:
    title = F.col("ten_sach")
    return [
        Check("category_not_found", F.col("_co_the_loai").isNull(), M.CATEGORY_UNKNOWN),
        Check(
            "blank_title",
            title.isNull() | (F.length(F.trim(title)) == 0),
            M.TITLE_BLANK,
        ),
        Check("negative_stock", F.col("so_luong") < 0, M.STOCK_NEGATIVE),
        Check("negative_price", F.col("don_gia") < 0, M.PRICE_NEGATIVE),
    ]


def _author_items(requests: DataFrame, match: Column, tables: Tables) -> DataFrame:
    """One row per item of an author list, resolved by stored id or stored name where possible."""
    listed = F.col("danh_sach_tac_gia")
    items = (
        requests.where(listed.isNotNull() & (F.length(F.trim(listed)) > 0))
        .select("request_id", "seq", F.posexplode(F.split(listed, ",")).alias("vi_tri", "muc"))
        .withColumn("muc", F.trim("muc"))
        .withColumn("_la_ma", F.col("muc").rlike(AUTHOR_ID))
        .withColumn("_ma", F.when(F.col("_la_ma"), F.col("muc").try_cast("bigint")))
        .withColumn("_ten", F.when(~F.col("_la_ma"), match))
    )
    by_id = tables.tac_gia.select(F.col("ma_tac_gia").alias("_ma"), F.lit(True).alias("_co_ma"))
    # A stored name may occur twice; the lowest id stands for it.
    by_name = (
        tables.tac_gia.withColumnRenamed("ten_tac_gia", "muc")
        .groupBy(match.alias("_ten"))
        .agg(F.min("ma_tac_gia").alias("_ma_theo_ten"))
    )
    return spread_join(spread_join(items, by_id, ["_ma"]), by_name, ["_ten"])


def ingest_books(
    tables: Tables, requests: DataFrame, collation: str | None = None
) -> NewBooks:
    """Insert books, link their authors and create authors known only by a new name.

    Items of the author list are ids (they must be stored already, or the request fails) or names.
    A new name becomes one author, however many requests of the batch use it. ``collation``
    loosens the name match; exact by default.
    """
    name = F.col("muc") if collation is None else F.collate(F.col("muc"), collation)
    categories = tables.the_loai.select("ma_the_loai", F.lit(True).alias("_co_the_loai"))
    code, message = first_failing(_checks())
    screened = requests.join(categories, "ma_the_loai", "left").withColumns(
        {"ly_do": code, "thong_bao": message}
    )
    items = durable(_author_items(requests, name, tables))
    unknown_id = (
        items.where(F.col("_la_ma") & F.col("_co_ma").isNull())
        .groupBy("request_id")
        .agg(F.min(F.struct("vi_tri", "muc")).alias("_sai"))
    )
    bad_author = F.col("_sai").isNotNull()
    settled = in_blocks(
        screened.join(unknown_id, "request_id", "left")
        .withColumn(
            "thong_bao",
            F.coalesce(
                "thong_bao",
                F.when(bad_author, fill(M.AUTHOR_UNKNOWN, "_sai.muc")),
            ),
        )
        .withColumn("ly_do", F.coalesce("ly_do", F.when(bad_author, "author_not_found")))
        .drop("_sai", "_co_the_loai", "danh_sach_tac_gia")
    )
    ok = F.col("ly_do").isNull()
    numbered = number_chosen(settled, ok, highest_id(tables.sach, "ma_sach"), "ma_sach")
    outcome = numbered.select(
        "request_id", "seq", ok.alias("thanh_cong"), "ly_do",
        F.when(ok, fill(M.BOOK_ADDED, "ma_sach")).otherwise(F.col("thong_bao")).alias("thong_bao"),
        "ma_sach",
    )
    made = numbered.where(ok)

    wanted = spread_join(
        items.drop("seq"), made.select("request_id", "seq", "ma_sach"), ["request_id"], "inner"
    )
    # The first accepted use of a new name gives it its place in the id order.
    first_use = (
        wanted.where(F.col("_ten").isNotNull() & F.col("_ma_theo_ten").isNull())
        .groupBy("_ten")
        .agg(F.min_by("muc", F.struct(*PLACE)).alias("muc"), F.min(F.struct(*PLACE)).alias("_place"))
        .select("_ten", "muc", "_place.*")
    )
    new_names = number_chosen(
        in_blocks(first_use, PLACE), F.lit(True), highest_id(tables.tac_gia, "ma_tac_gia"),
        "ma_tac_gia", PLACE,
    )
    authors = new_names.select(
        "ma_tac_gia", F.col("muc").alias("ten_tac_gia"), F.lit(M.NEW_AUTHOR_NOTE).alias("mo_ta")
    )
    known = F.coalesce("_ma", "_ma_theo_ten")
    links = (
        spread_join(
            wanted, new_names.select("_ten", F.col("ma_tac_gia").alias("_ma_moi")), ["_ten"], "left"
        )
        .select(F.coalesce(known, F.col("_ma_moi")).alias("ma_tac_gia"), "ma_sach")
        .distinct()
    )
    return NewBooks(outcome, made.select(*columns("sach")), authors, links)
