"""Which parts of a table may hold a value: Bloom filters on identity numbers and phones.

Readers and staff are laid out by their own id, so a new row's identity number could be in any part of
a release. The index keeps a set of bits for each part and column, in which every value sets a few.
A part in which one of the bits of an asked value is missing does not hold it. Only parts that may
hold some asked value are opened and compared, so the answer is exact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from circdesk.model.schema import KEYS
from circdesk.operators.checks import UNIQUE, Checked, check_unique, identifiers
from circdesk.sources.versions import VALUES, current_release, read_parts, values_set

BITS_PER_VALUE = 12
_HASHES = 4
_PAGE = 32_768  # bits in one row of the index, as many as a bitmap aggregate makes
_SHAPE = "noi_luu string, cot string, trang bigint, so_trang bigint, bit binary"


@dataclass(frozen=True)
class Membership:
    """The index of one table's releases under ``base``, in a folder of its own."""

    spark: SparkSession
    base: str
    folder: str
    table: str = "doc_gia"

    def update(self) -> int:
        """Index the parts of the newest release that are not indexed yet, and give their number."""
        release, known = current_release(self.spark, self.base), set(self._known())
        new = [p.place for p in release.parts[self.table] if p.kind != VALUES and p.place not in known]
        for place in new:
            rows = self.spark.read.parquet(place).select(*UNIQUE)
            _index(rows, place).write.parquet(f"{self.folder.rstrip('/')}/{uuid.uuid4().hex}")
        return len(new)

    def _known(self) -> list[str]:
        return [r.noi_luu for r in self._rows().select("noi_luu").distinct().collect()]  # one row per part

    def _rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _SHAPE)
        return self.spark.read.schema(_SHAPE).parquet(f"{self.folder.rstrip('/')}/*")

    def parts_for(self, people: DataFrame) -> list[str]:
        """Parts of the newest release that may hold an identity number or phone of ``people``.

        Every asked value is held against each part's bits, as many rows as values times parts (which
        compaction keeps few) and hashes, and no table row is read. Parts that are not indexed may hold anything.
        """
        index = self._rows()
        sizes = index.select("noi_luu", "cot", "so_trang").distinct()
        asked = identifiers(people, []).distinct().join(F.broadcast(sizes), "cot")  # two rows per part
        places = F.array(*[F.pmod(_hash(s), F.col("so_trang") * _PAGE) for s in range(_HASHES)])
        wanted = asked.select("noi_luu", "cot", "gia_tri", F.explode(places).alias("h")).withColumn("trang", F.expr(f"h div {_PAGE}"))
        key = ["noi_luu", "cot", "trang"]
        bits = wanted.join(index.select(*key, "bit"), key, "left").withColumn(
            "co", F.coalesce(_bit(F.col("bit"), (F.col("h") % _PAGE).cast("int")), F.lit(False)))
        maybe = bits.groupBy("noi_luu", "cot", "gia_tri").agg(F.min("co").alias("co")).where("co")
        hit, known = {r.noi_luu for r in maybe.select("noi_luu").distinct().collect()}, set(self._known())
        release = current_release(self.spark, self.base)
        return [p.place for p in release.parts[self.table] if p.kind != VALUES and (p.place in hit or p.place not in known)]

    def holders(self, people: DataFrame) -> DataFrame:
        """Key, identity number and phone, as they are now, of the rows in the parts that may hold an asked value.

        Values set by updates lie in small parts of their own, which are always read. Rows of other people come
        along; the check compares.
        """
        key, release = KEYS[self.table][0], current_release(self.spark, self.base)
        rows = read_parts(self.spark, release, self.table, self.parts_for(people)).select(key, *UNIQUE)
        later = values_set(self.spark, release, self.table)
        if later is None or not set(UNIQUE) & set(later.columns):
            return rows
        none = F.lit(None).cast("string")
        return rows.unionByName(
            later.select(key, *[(F.col(f"{c}.v") if c in later.columns else none).alias(c) for c in UNIQUE]))

    def check(self, people: DataFrame, strict: bool = False, changed: bool = False) -> Checked:
        """The uniqueness check of new people, or of changed ones, with the parts that matter instead of the table."""
        return check_unique(self.holders(people), KEYS[self.table][0], people, strict, changed)


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("cot"), F.col("gia_tri"))


def _index(rows: DataFrame, place: str) -> DataFrame:
    """The bits of a part, one set per column, cut into pages."""
    values = identifiers(rows, [])
    sizes = values.groupBy("cot").agg(F.ceil(F.count(F.lit(1)) * BITS_PER_VALUE / _PAGE).cast("bigint").alias("so_trang"))
    hashed = values.join(F.broadcast(sizes), "cot").select(  # one row per column
        "cot", "so_trang", F.explode(F.array(*[F.pmod(_hash(s), F.col("so_trang") * _PAGE) for s in range(_HASHES)])).alias("h"))
    return hashed.groupBy("cot", "so_trang", F.expr(f"h div {_PAGE}").alias("trang")).agg(
        F.bitmap_construct_agg(F.col("h") % _PAGE).alias("bit")
    ).select(F.lit(place).alias("noi_luu"), "cot", "trang", "so_trang", "bit")


def _bit(bitmap: Column, place: Column) -> Column:
    """Whether a bit of a bitmap aggregate's result is set: byte place div 8, the lowest bit first."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(place, F.lit(8))).cast("int")) != 0
