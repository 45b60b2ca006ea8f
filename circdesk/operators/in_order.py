"""Checks of new rows in which statements count one after another.

The checks of ``circdesk.operators.checks`` hold every statement against the stored tables alone. Here
an accepted statement stands in the way of later ones, as if each were checked when the earlier ones
had been stored. The result does not depend on how the statements are cut into batches, which is
what a stream needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from circdesk.model.tables import Tables
from circdesk.operators.admission import KEY, refused_requests
from circdesk.operators.checks import identifiers, with_statement, without_statements
from circdesk.operators.ordering import REQUEST_ORDER, in_blocks
from circdesk.operators.scratch import durable
from circdesk.operators.skew import few_per_key


def admit_extensions(tables: Tables, inserted: DataFrame) -> DataFrame:
    """New extension requests whose line has no request yet, stored or accepted before (``statement_id`` order).

    A statement that names a line twice is refused; rows without a line key are of no line and pass.
    """
    rows = with_statement(inserted)
    return _first_come(rows, rows, tables.yeu_cau_gia_han, F.col("ma_sach").cast("string"), F.col("ma_phieu_muon"))


def admit_readers(tables: Tables, inserted: DataFrame) -> DataFrame:
    """New readers whose identity number and phone nobody has, stored or accepted before; nulls never match."""
    return _admit_people(tables.doc_gia, "ma_doc_gia", inserted)


def admit_staff(tables: Tables, inserted: DataFrame) -> DataFrame:
    """The same among staff."""
    return _admit_people(tables.nhan_vien, "ma_nhan_vien", inserted)


def _admit_people(existing: DataFrame, key: str, inserted: DataFrame) -> DataFrame:
    rows = with_statement(inserted)
    name, group = F.col("gia_tri"), F.when(F.col("cot") == "cccd", 0).otherwise(1).cast("bigint")
    return _first_come(rows, identifiers(rows, ["statement_id", key]), identifiers(existing, [key]), name, group)


def _first_come(rows: DataFrame, asked: DataFrame, stored: DataFrame, name: Column, group: Column) -> DataFrame:
    """``rows`` of the statements whose keys are all free when their turn comes; a key is given once."""
    taken = few_per_key(stored.select(name.alias("loai"), group.alias("khoa"), F.col(stored.columns[0])), KEY)
    demand = (
        asked.select("statement_id", name.alias("loai"), group.alias("khoa"))
        .where("loai is not null and khoa is not null")
        .groupBy("statement_id", *KEY).agg(F.count(F.lit(1)).alias("so_luong"))
    )
    gone = demand.join(taken, KEY, "left_semi").select("statement_id")
    open_ = without_statements(demand, gone)
    claims = open_.withColumns({
        "request_id": F.col("statement_id"), "seq": F.col("statement_id"), "suc_chua": F.lit(1).cast("bigint"),
    })
    refused = refused_requests(in_blocks(durable(claims), (*REQUEST_ORDER, *KEY)))
    return without_statements(rows, gone.unionByName(refused.select(F.col("request_id").alias("statement_id"))))
