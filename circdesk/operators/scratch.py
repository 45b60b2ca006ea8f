"""Intermediate results that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # folders of local sessions that name none
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only for local sessions without it."""
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
    session = spark.sparkContext.applicationId
    if session not in _own:
        _own[session] = tempfile.mkdtemp(prefix="circdesk-")
    return _own[session]


@contextmanager
def noting() -> Iterator[list[str]]:
    """The folders that ``durable`` writes inside the block, for ``remove`` once nothing reads them any more."""
    places: list[str] = []
    token = _noted.set(places)
    try:
        yield places
    finally:
        _noted.reset(token)


def remove(spark: SparkSession, places: Iterable[str]) -> None:
    """Delete folders that ``durable`` wrote."""
    jvm = spark.sparkContext._jvm
    for place in places:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable_by(df: DataFrame, key: str) -> DataFrame:
    """Like ``durable``, in buckets of a key: joins on it shuffle the other side only, however often they come."""
    spark, name = df.sparkSession, f"circdesk_{uuid.uuid4().hex}"
    path, width = _new_place(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(width, key).write.format("parquet").option("path", path).bucketBy(width, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def _new_place(spark: SparkSession) -> str:
    path = f"{scratch_folder(spark).rstrip('/')}/circdesk/{uuid.uuid4().hex}"
    noted = _noted.get()
    if noted is not None:
        noted.append(path)
    return path


def durable(df: DataFrame, **counts: Column) -> DataFrame | tuple[DataFrame, dict[str, int]]:
    """Write ``df`` once and go on from the files.

    The lineage is cut there, several outputs can share the work, and a later stage that is
    recomputed reads the very same rows. Named ``counts`` (aggregate columns) are taken while
    writing and returned beside the rows.
    """
    spark = df.sparkSession
    path = _new_place(spark)
    if not counts:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(seen.get)
