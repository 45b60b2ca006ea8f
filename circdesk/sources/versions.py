"""Publishing table changes as new versions that readers see all at once or not at all.

A table is a list of parts, folders of Parquet files. Parts of rows are laid out by a bucket of the
first key column. An append adds such a part, and an update adds a part that holds only keys and new
values: no file that is there already is written again. Readers put the new values over the rows.
``compact`` writes the buckets that have new values anew, once these have become many, and hides them
in the older parts. Files are sorted by key and have Bloom filters on it, so that a reader of few
keys skips most of them.

Last, one small list is put in place that says which parts, without which buckets, the tables now
consist of. Readers follow the newest list, so a job that dies half way leaves nothing visible, and
of two jobs that start from the same release only one can publish.

With a release go the numbers of loan lines per book and per card in each status. They are parts of
signed differences, one for each release that changes lines, so keeping them up reads no lines.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from circdesk.model.schema import KEYS, columns, schema
from circdesk.model.tables import Tables

BUCKETS = 64
_BUCKET = "_nhom"
_LIST = (
    "release bigint, nguon string, bang string, noi_luu string, bo_qua array<int>, ket_qua string, "
    "loai string, cot array<string>, nhom array<int>, so_dong bigint, tu bigint"
)
ROWS, VALUES, COMPACTED, REPLACED = "dong", "sua", "gop", "thay"  # kinds of parts

# Maintained counts: what each is counted by, beside the status.
COUNTS = {"dem_sach": "ma_sach", "dem_the": "ma_the"}
_COUNT = "{key} bigint, trang_thai_muon string, so_dong bigint"


@dataclass(frozen=True)
class Part:
    place: str
    hidden: tuple[int, ...] = ()  # buckets that a later part replaces
    kind: str = ROWS
    sets: tuple[str, ...] = ()  # columns that a part of values sets
    buckets: tuple[int, ...] = ()  # that occur in it
    rows: int = 0
    made: int = 0  # number of the release it was made for


@dataclass(frozen=True)
class Release:
    number: int = 0
    parts: Mapping[str, tuple[Part, ...]] = field(default_factory=dict)
    outcome: str | None = None  # where the outcomes of the batch are that made this release


@dataclass(frozen=True)
class Update:
    """New values of ``set_columns`` for the keys in ``changes``, at most one row per key.

    A change of ``trang_thai_muon`` may bring the status before it as ``trang_thai_cu``, which spares
    looking it up for the counts.
    """

    changes: DataFrame
    set_columns: Sequence[str]


@dataclass(frozen=True)
class Changes:
    """What a batch does to the tables: rows added, rows updated, tables replaced, and its outcomes."""

    appended: Mapping[str, DataFrame] = field(default_factory=dict)
    updated: Mapping[str, Update] = field(default_factory=dict)
    replaced: Mapping[str, DataFrame] = field(default_factory=dict)
    outcome: DataFrame | None = None


class AlreadyPublished(RuntimeError):
    """Another writer has published the release this one was about to make."""


def _numbers(spark: SparkSession, base: str) -> list[int]:
    folder = _path(spark, f"{base.rstrip('/')}/_releases")
    store = _store(spark, base)
    if not store.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in store.listStatus(folder) if f.getPath().getName().isdigit())


def _path(spark: SparkSession, place: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)


def _store(spark: SparkSession, place: str):
    """The file system that holds a place."""
    return _path(spark, place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _list(spark: SparkSession, base: str, number: int) -> list:
    return spark.read.schema(_LIST).json(f"{base.rstrip('/')}/_releases/{number:012d}").collect()


def current_release(spark: SparkSession, base: str, number: int | None = None) -> Release:
    """The newest complete release or the one of that number; number 0 before the first one.

    One row per part reaches the driver.
    """
    numbers = _numbers(spark, base)
    if not numbers:
        return Release()
    if number is not None and number not in numbers:
        raise FileNotFoundError(f"no release {number} under {base}")
    number = numbers[-1] if number is None else number
    parts: dict[str, tuple[Part, ...]] = {}
    rows = _list(spark, base, number)
    for r in sorted((r for r in rows if r.bang), key=lambda r: r.noi_luu):
        part = Part(r.noi_luu, tuple(r.bo_qua or ()), r.loai or ROWS, tuple(r.cot or ()), tuple(r.nhom or ()),
                    r.so_dong or 0, r.tu or 0)
        parts[r.bang] = (*parts.get(r.bang, ()), part)
    return Release(number, parts, next((r.ket_qua for r in rows if r.ket_qua), None))


def is_published(spark: SparkSession, base: str, source: str) -> bool:
    """Whether the named piece of input is already part of a release."""
    try:
        lists = spark.read.schema(_LIST).json(f"{base.rstrip('/')}/_releases/*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return not lists.where(F.col("nguon") == source).isEmpty()


def read_release(spark: SparkSession, base: str, number: int | None = None) -> Tables:
    """The tables of the newest release or the one of that number, with its counts of lines."""
    release = current_release(spark, base, number)
    if not release.number:
        raise FileNotFoundError(f"no release under {base}")
    counts = {n: partial(_read_counts, spark, release, n) for n in COUNTS if n in release.parts}
    return Tables(**{n: partial(_read, spark, release, n) for n in Tables.names()}).counted(**counts)


def read_outcome(spark: SparkSession, base: str) -> DataFrame | None:
    """The outcomes of the batch that made the newest release, if it had any."""
    place = current_release(spark, base).outcome
    return spark.read.parquet(place) if place else None


def read_parts(spark: SparkSession, release: Release, name: str, places: Collection[str]) -> DataFrame:
    """The rows of some of a table's parts, as they are now."""
    return _read(spark, release, name, places=places)


def _read(
    spark: SparkSession, release: Release, name: str, buckets: Sequence[int] | None = None,
    places: Collection[str] | None = None,
) -> DataFrame:
    """A table of a release, or only some of its buckets or parts; others are not opened."""
    shape = schema(name).add(_BUCKET, T.IntegerType())
    whole = spark.createDataFrame([], schema(name)) if places is not None and not places else None
    for part in release.parts[name]:
        if part.kind != VALUES and (places is None or part.place in places):
            rows = _of_buckets(spark.read.schema(shape).parquet(part.place), part, buckets).select(*columns(name))
            whole = rows if whole is None else whole.unionByName(rows)
    values = _values(spark, release, name, buckets)
    if values is None:
        return whole
    keys, sets = KEYS[name], [c for c in values.columns if c not in KEYS[name]]
    over = values.select(*keys, *[F.col(c).alias(f"_moi_{c}") for c in sets])
    return whole.join(over, list(keys), "left").select(*[
        F.when(F.col(f"_moi_{c}").isNotNull(), F.col(f"_moi_{c}.v")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
        for c in columns(name)
    ])


def _of_buckets(rows: DataFrame, part: Part, buckets: Sequence[int] | None) -> DataFrame:
    if part.hidden:
        rows = rows.where(~F.col(_BUCKET).isin(*part.hidden))
    return rows if buckets is None else rows.where(F.col(_BUCKET).isin(*buckets))


def _shape(name: str, sets: Sequence[str]) -> T.StructType:
    return T.StructType([f for f in schema(name) if f.name in (*KEYS[name], *sets)]).add(_BUCKET, T.IntegerType())


def values_set(spark: SparkSession, release: Release, name: str) -> DataFrame | None:
    """What updates since the last compaction have set: keys, and per column a struct whose ``v`` is the last value."""
    return _values(spark, release, name)


def _values(
    spark: SparkSession, release: Release, name: str, buckets: Sequence[int] | None = None, made_after: int = 0
) -> DataFrame | None:
    """The last value set for each key and column: keys, and per column a struct (n, v), null if never set."""
    parts = [
        p for p in release.parts[name] if p.kind == VALUES and p.made > made_after
        and set(p.buckets) - set(p.hidden) and (buckets is None or set(p.buckets) & set(buckets))
    ]
    if not parts:
        return None
    types = {f.name: f.dataType for f in schema(name)}
    sets = sorted({c for p in parts for c in p.sets}, key=columns(name).index)
    whole = None
    for n, part in enumerate(parts):
        rows = _of_buckets(spark.read.schema(_shape(name, part.sets)).parquet(part.place), part, buckets)
        empty = {c: F.lit(None).cast(T.StructType().add("n", T.IntegerType()).add("v", types[c])) for c in sets}
        rows = rows.select(*KEYS[name], *[
            (F.struct(F.lit(n).alias("n"), F.col(c).alias("v")) if c in part.sets else empty[c]).alias(c) for c in sets])
        whole = rows if whole is None else whole.unionByName(rows)
    if len(parts) == 1:
        return whole
    return whole.groupBy(*KEYS[name]).agg(*[F.max_by(c, F.col(c)["n"]).alias(c) for c in sets])


def _read_counts(spark: SparkSession, release: Release, name: str) -> DataFrame:
    key = COUNTS[name]
    places = [p.place for p in release.parts[name]]
    rows = spark.read.schema(_COUNT.format(key=key)).parquet(*places)
    return rows.groupBy(key, "trang_thai_muon").agg(F.sum("so_dong").alias("so_dong")).where("so_dong <> 0")


def _bucket(name: str):
    return F.pmod(F.xxhash64(KEYS[name][0]), F.lit(BUCKETS)).cast("int")


def _lay(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a table dealt by bucket and, inside it, by a hash of the whole key; the bucket is not shuffled with them."""
    return rows.repartition(_bucket(name), F.pmod(F.xxhash64(*KEYS[name]), F.lit(16)))


def publish(
    spark: SparkSession, base: str, changed: Mapping[str, DataFrame] | Changes, source: str | None = None,
    after: Release | None = None,
) -> int:
    """Write the changes and make them the newest release; gives its number.

    A plain mapping replaces whole tables. ``source`` names the input the changes come from, for
    ``is_published``. ``after`` is the release the changes were worked out from (default: the newest);
    if another writer has published since, nothing becomes visible and ``AlreadyPublished`` is raised.
    """
    changes = changed if isinstance(changed, Changes) else Changes(replaced=changed)
    named = {*changes.appended, *changes.updated, *changes.replaced}
    if unknown := named - set(Tables.names()):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    before = after or current_release(spark, base)
    if missing := set(Tables.names()) - set(before.parts) - set(changes.replaced):
        raise ValueError(f"the first release needs every table, missing: {sorted(missing)}")
    number, parts = before.number + 1, dict(before.parts)
    added: dict[str, list[Part]] = {}
    for name, rows in changes.replaced.items():
        parts[name] = (_write(spark, base, number, name, rows, REPLACED),)
    for name, update in changes.updated.items():
        part = _write(spark, base, number, name, update.changes, VALUES, update.set_columns)
        if part.rows:
            parts[name] = (*parts[name], part)
            added.setdefault(name, []).append(part)
    for name, rows in changes.appended.items():
        part = _write(spark, base, number, name, rows, ROWS)
        if part.rows:
            parts[name] = (*parts[name], part)
            added.setdefault(name, []).append(part)
    now = Release(number, parts)
    if {"chi_tiet", "phieu_muon"} & set(changes.replaced) or not set(COUNTS) <= set(parts):
        parts |= _whole_counts(spark, base, now)
    elif "chi_tiet" in added:
        for name, part in _count_changes(spark, base, before, now, added["chi_tiet"]).items():
            parts[name] = (*parts[name], part)
    outcome = None
    if changes.outcome is not None:
        outcome = f"{base.rstrip('/')}/_outcomes/{number:012d}-{uuid.uuid4().hex}"
        changes.outcome.write.parquet(outcome)
    _put(spark, base, Release(number, parts, outcome), source)
    return number


def _new_place(base: str, number: int, name: str) -> str:
    # The highest number sorts last, and of one release rows come after values: parts are listed in the order of making.
    return f"{base.rstrip('/')}/{name}/{number:012d}-{time.time_ns():020d}-{uuid.uuid4().hex}"


def _write(
    spark: SparkSession, base: str, number: int, name: str, rows: DataFrame, kind: str, sets: Sequence[str] = ()
) -> Part:
    """A part of whole rows in a folder per bucket, or of keys and new values in few files."""
    place = _new_place(base, number, name)
    key = KEYS[name][0]
    if kind == VALUES:
        # The status before a change is kept beside the values for the counts; readers don't see it.
        more = [F.col("trang_thai_cu")] if "trang_thai_cu" in rows.columns else []
        laid = rows.select(*KEYS[name], *[F.col(c).cast(_shape(name, sets)[c].dataType).alias(c) for c in sets], *more)
    else:
        if kind == ROWS:  # new rows may leave columns out
            rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema(name) if f.name not in rows.columns})
        laid = rows.select(*columns(name))
    laid = _lay(laid, name).withColumn(_BUCKET, _bucket(name)).sortWithinPartitions(_BUCKET, *KEYS[name])
    seen = Observation()
    counted = laid.observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(_BUCKET).alias("buckets"))  # at most BUCKETS
    writer = counted.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{key}", "100000")
    (writer if kind == VALUES else writer.partitionBy(_BUCKET)).parquet(place)
    return Part(place, (), kind, tuple(sets), tuple(sorted(seen.get["buckets"] or ())), seen.get["n"], number)


def _write_counts(spark: SparkSession, base: str, number: int, name: str, rows: DataFrame, kind: str) -> Part:
    part = Part(_new_place(base, number, name), kind=kind, made=number)
    rows.write.parquet(part.place)
    return part


def _per_status(lines: DataFrame, key: str, amount: str = "1L") -> DataFrame:
    return lines.groupBy(key, "trang_thai_muon").agg(F.sum(F.expr(amount)).alias("so_dong")).where("so_dong <> 0")


def _per_card(lines: DataFrame, slips: DataFrame, amount: str = "1L") -> DataFrame:
    """Lines per card and status: counted per slip first, so that rows of one card meet as counts."""
    per_slip = _per_status(lines, "ma_phieu_muon", amount)
    return _per_status(per_slip.join(slips.select("ma_phieu_muon", "ma_the"), "ma_phieu_muon"), "ma_the", "so_dong")


def _whole_counts(spark: SparkSession, base: str, release: Release) -> dict[str, tuple[Part, ...]]:
    lines, slips = _read(spark, release, "chi_tiet"), _read(spark, release, "phieu_muon")
    return {
        name: (_write_counts(spark, base, release.number, name, rows, REPLACED),)
        for name, rows in (("dem_sach", _per_status(lines, "ma_sach")), ("dem_the", _per_card(lines, slips)))
    }


def _count_changes(spark: SparkSession, base: str, before: Release, now: Release, added: list[Part]) -> dict[str, Part]:
    """What a release adds to the counts: a line is gone from its old status and there in its new one.

    Only the parts that the release adds are read, and the slips of their buckets; lines are looked up
    only for a change of status that does not say what it was, and then in its buckets.
    """
    signed = None
    for part in added:
        if part.kind == ROWS:
            rows = spark.read.schema(schema("chi_tiet")).parquet(part.place)
            now_in = rows.select("ma_phieu_muon", "ma_sach", "trang_thai_muon", F.lit(1).cast("bigint").alias("so_dong"))
        elif "trang_thai_muon" in part.sets:
            rows = spark.read.parquet(part.place)
            if "trang_thai_cu" not in rows.columns:
                old = _read(spark, before, "chi_tiet", part.buckets).select(
                    *KEYS["chi_tiet"], F.col("trang_thai_muon").alias("trang_thai_cu"))
                rows = rows.join(old, list(KEYS["chi_tiet"]))
            both = F.array(
                F.struct(F.col("trang_thai_cu").alias("trang_thai_muon"), F.lit(-1).cast("bigint").alias("so_dong")),
                F.struct(F.col("trang_thai_muon"), F.lit(1).cast("bigint").alias("so_dong")))
            now_in = rows.select("ma_phieu_muon", "ma_sach", F.explode(both).alias("x")).select("ma_phieu_muon", "ma_sach", "x.*")
        else:
            continue
        signed = now_in if signed is None else signed.unionByName(now_in)
    if signed is None:
        return {}
    slips = _read(spark, now, "phieu_muon", sorted({b for p in added for b in p.buckets}))
    return {
        "dem_sach": _write_counts(spark, base, now.number, "dem_sach", _per_status(signed, "ma_sach", "so_dong"), ROWS),
        "dem_the": _write_counts(spark, base, now.number, "dem_the", _per_card(signed, slips, "so_dong"), ROWS),
    }


def compact(spark: SparkSession, base: str, share: float = 0.0) -> int:
    """Write the buckets with new values anew and add up the counts; the number of the newest release.

    Done for tables in which the values set are at least ``share`` of the rows, and for counts spread
    over more than one part. Nothing changes for readers. Without anything to do no release is made.
    """
    before = current_release(spark, base)
    number, parts = before.number + 1, dict(before.parts)
    for name in Tables.names():
        values = [p for p in parts[name] if p.kind == VALUES]
        rows = sum(p.rows for p in parts[name] if p.kind != VALUES)
        touched = sorted({b for p in values for b in set(p.buckets) - set(p.hidden)})
        if touched and sum(p.rows for p in values) >= share * rows:
            new = _write(spark, base, number, name, _read(spark, before, name, touched), COMPACTED)
            hiding = [replace(p, hidden=tuple(sorted({*p.hidden, *touched}))) for p in parts[name]]
            parts[name] = (*[p for p in hiding if set(p.buckets) - set(p.hidden)], new)
    for name in COUNTS:
        if len(parts.get(name, ())) > 1:
            parts[name] = (_write_counts(spark, base, number, name, _read_counts(spark, before, name), COMPACTED),)
    if parts == before.parts:
        return before.number
    _put(spark, base, Release(number, parts, before.outcome), None)
    return number


@dataclass(frozen=True)
class Feed:
    """Rows of a table that differ between two releases: as they were, and as they are. Same columns."""

    before: DataFrame
    after: DataFrame


def changes_between(spark: SparkSession, base: str, name: str, older: int, newer: int | None = None) -> Feed:
    """The rows of a table that releases after ``older``, up to ``newer``, added or changed.

    The parts those releases made say which keys; their rows are read from the buckets these are in,
    and only such bucket folders are opened. If one of the releases replaced the table, all rows are
    compared. Rows set to the values they had come along.
    """
    first = current_release(spark, base, older)
    last = current_release(spark, base, newer)
    made: dict[str, Part] = {}
    for number in [n for n in _numbers(spark, base) if first.number < n <= last.number]:
        made |= {p.place: p for p in current_release(spark, base, number).parts[name] if p.made == number}
    keys = list(KEYS[name])
    if any(p.kind == REPLACED for p in made.values()):
        old, new = _read(spark, first, name), _read(spark, last, name)
        return Feed(old.exceptAll(new), new.exceptAll(old))
    touched = sorted({b for p in made.values() if p.kind != COMPACTED for b in p.buckets})
    asked = None
    for part in made.values():
        if part.kind != COMPACTED:
            rows = spark.read.schema(_shape(name, ())).parquet(part.place).select(*keys)
            asked = rows if asked is None else asked.unionByName(rows)
    if asked is None:
        nothing = _read(spark, last, name, [])
        return Feed(nothing, nothing)
    return Feed(*[_read(spark, r, name, touched).join(asked, keys, "left_semi") for r in (first, last)])


def _put(spark: SparkSession, base: str, release: Release, source: str | None) -> None:
    """Write the list aside and rename it to its number, which fails if another list has that name."""
    number = release.number
    rows = [
        (number, source, n, p.place, list(p.hidden), None, p.kind, list(p.sets), list(p.buckets), p.rows, p.made)
        for n, own in sorted(release.parts.items()) for p in own
    ]
    rows.append((number, source, None, None, None, release.outcome, *[None] * 5))
    aside, target = f"{base.rstrip('/')}/_aside/{uuid.uuid4().hex}", f"{base.rstrip('/')}/_releases/{number:012d}"
    spark.createDataFrame(rows, _LIST).coalesce(1).write.json(aside)
    store, hadoop = _store(spark, aside), spark.sparkContext._jvm.org.apache.hadoop.fs
    written = next(f.getPath() for f in store.listStatus(_path(spark, aside)) if f.getPath().getName().startswith("part-"))
    store.mkdirs(_path(spark, target).getParent())
    never_over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    never_over[0] = getattr(hadoop, "Options$Rename").NONE
    files = hadoop.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(store.makeQualified(written), store.makeQualified(_path(spark, target)), never_over)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise AlreadyPublished(f"another writer has published release {number}") from error
        raise


def unused_places(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Folders of tables and outcomes that none of the newest ``keep`` releases refers to.

    They belong to older releases or to jobs that did not finish. Only look at them while no job is
    writing and no reader follows an older release; then they can be removed.
    """
    used: set[str] = set()
    for number in _numbers(spark, base)[-keep:]:
        for r in _list(spark, base, number):
            used |= {p.rstrip("/").rpartition(base.rstrip("/"))[2] for p in (r.noi_luu, r.ket_qua) if p}
    found = []
    for name in (*Tables.names(), *COUNTS, "_outcomes"):
        folder = _path(spark, f"{base.rstrip('/')}/{name}")
        store = _store(spark, base)
        if store.exists(folder):
            found += [f"/{name}/{f.getPath().getName()}" for f in store.listStatus(folder)]
    return [f"{base.rstrip('/')}{p}" for p in sorted(found) if p not in used]


def remove_unused(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Remove what ``unused_places`` lists, under its conditions; the number of folders removed."""
    places = unused_places(spark, base, keep)
    for place in places:
        _store(spark, place).delete(_path(spark, place), True)
    return len(places)


Step = Callable[[Tables, DataFrame], Changes]
