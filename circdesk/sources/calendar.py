"""What falls due on which day, so that time-driven work reads only the days since its last run.

Three lists are stored in a folder per day: unreturned lines by due day, cards by expiry day and
waiting extension requests by the day they run out. An entry counts 1; when its row changes, a
further one takes it back with -1 and the changed row enters again, so the lists follow the tables by
what is appended to them. A run from one moment to a later one opens the folders of the days
between and neither the other days nor the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from circdesk.functions.dates import moment, plus_days
from circdesk.model import vocab as V
from circdesk.model.tables import Tables
from circdesk.operators.measures import AsOf
from circdesk.sources.versions import Feed

WAITING_DAYS = 3  # after which a waiting request is turned down
LINES, CARDS, REQUESTS = "chi_tiet", "the_thu_vien", "yeu_cau_gia_han"
_KEYS = {LINES: ("ma_phieu_muon", "ma_sach", "ma_the"), CARDS: ("ma_the", "ma_doc_gia"), REQUESTS: ("ma_yeu_cau",)}
_DAY = "ngay"


@dataclass(frozen=True)
class Calendar:
    """The lists under a folder."""

    spark: SparkSession
    folder: str

    def add(self, tables: Tables) -> None:
        """Enter all rows that count: the start of a calendar."""
        for name in _KEYS:
            self._enter(name, _entries(name, getattr(tables, name), tables), 1)

    def follow(self, name: str, feed: Feed, tables: Tables) -> None:
        """Take a table's changes over: its rows as they were go, and as they are now they enter."""
        self._enter(name, _entries(name, feed.before, tables), -1, _entries(name, feed.after, tables))

    def _enter(self, name: str, rows: DataFrame, sign: int, more: DataFrame | None = None) -> None:
        signed = rows.withColumn("dau", F.lit(sign))
        if more is not None:
            signed = signed.unionByName(more.withColumn("dau", F.lit(1)))
        dated = signed.where("luc is not null").withColumn(_DAY, F.col("luc").cast("date"))
        # A day may be long: its rows go to several files.
        spread = dated.repartition(_DAY, F.pmod(F.xxhash64(_KEYS[name][0]), F.lit(16)))
        spread.write.mode("append").partitionBy(_DAY).parquet(self._place(name))

    def _place(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def between(self, name: str, since: AsOf | None, until: AsOf) -> DataFrame:
        """Keys and moment (``luc``) of what falls due from ``since`` (in) to ``until`` (out); None: from the first day."""
        shape = ", ".join(f"{k} bigint" for k in _KEYS[name]) + f", luc timestamp_ntz, dau int, {_DAY} date"
        rows = self.spark.read.schema(shape).parquet(self._place(name))
        rows = rows.where((F.col(_DAY) <= moment(until).cast("date")) & (F.col("luc") < moment(until)))
        if since is not None:
            rows = rows.where((F.col(_DAY) >= moment(since).cast("date")) & (F.col("luc") >= moment(since)))
        keys = [*_KEYS[name], "luc"]
        return rows.groupBy(*keys).agg(F.sum("dau").alias("_n")).where("_n > 0").select(*keys)


def _entries(name: str, rows: DataFrame, tables: Tables) -> DataFrame:
    """Keys and moment of the rows of a table that count."""
    if name == LINES:
        open_ = rows.where(F.col("trang_thai_muon").isin(*V.OPEN) & F.col("ngay_tra_thuc_te").isNull())
        slips = tables.phieu_muon.select("ma_phieu_muon", "ma_the")
        return open_.join(slips, "ma_phieu_muon", "left").select(*_KEYS[name], F.col("ngay_tra_du_kien").alias("luc"))
    if name == CARDS:
        return rows.select(*_KEYS[name], F.col("ngay_het_han").alias("luc"))
    waiting = rows.where(F.col("trang_thai") == V.CHO)
    return waiting.select(*_KEYS[name], _runs_out().alias("luc"))


def _runs_out() -> Column:
    return plus_days(F.col("ngay_tao"), WAITING_DAYS)


def newly_overdue(calendar: Calendar, since: AsOf | None, until: AsOf) -> DataFrame:
    """Unreturned lines that have become overdue since the last run, with their card."""
    return calendar.between(LINES, since, until).withColumnRenamed("luc", "ngay_tra_du_kien")


def cards_to_lock(calendar: Calendar, since: AsOf | None, until: AsOf) -> DataFrame:
    """Cards that such lines put into debt."""
    return newly_overdue(calendar, since, until).where("ma_the is not null").select("ma_the").distinct()


def newly_expired_cards(calendar: Calendar, since: AsOf | None, until: AsOf) -> DataFrame:
    """Cards that have expired since the last run."""
    return calendar.between(CARDS, since, until).withColumnRenamed("luc", "ngay_het_han")


def requests_to_reject(calendar: Calendar, since: AsOf | None, until: AsOf) -> DataFrame:
    """Requests that wait and whose days have run out since the last run."""
    return calendar.between(REQUESTS, since, until).select("ma_yeu_cau")
