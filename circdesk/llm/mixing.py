"""Mixing sources to target weights by pivotal dependent rounding.

Every document should occur ``target / source size`` times. The whole part of that is given to all;
the fractions are settled in pairs: one document hands words to the other, at random but fair, until
one of the two fractions is 0 or 1. The words of the source stay the same in every such step. What
a group leaves open goes up a reduction tree, whose root rounds at most one document per source and
evens out that rounding among the few documents that have reached it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from circdesk.llm.support import durable, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
_OPEN = 8


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS
) -> DataFrame:
    """One row per source: source, source_no, source_size, target.

    ``sizes`` has source and size. Sources in code-point order, null last, take the weights in turn
    and share the total size by them. No target exceeds ``most`` times its source; what is cut off
    is shared again by weight. That fixed point is found in one pass over the sources in the order
    in which they reach their limit. The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name))
        .withColumn("weight", turn)
        .withColumn("most", F.col("source_size") * float(most))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    )
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / (
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    )
    filled = sources.withColumn("level", level).withColumn("place", F.row_number().over(order))
    level = F.min_by(
        F.when(F.col("most") >= F.col("weight") * F.col("level"), F.col("level")),
        F.when(F.col("most") >= F.col("weight") * F.col("level"), F.col("place")),
    ).over(Window.partitionBy())
    return filled.withColumn("shared", F.coalesce(level, F.lit(float("inf")))).select(
        "source", "source_no", "source_size",
        F.least("most", F.col("weight") * F.col("shared")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST_REPEATS,
    seed: int = 7,
    group_rows: int = 1000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Size is the number of words; null and empty texts have size 0 and are taken as often as chance
    by their rate says. Repeated rows (same doc_id, source and size) are settled together and all get
    the same number of copies. Null sources form one source. An empty table gives an empty result. The
    same input gives the same mix. Only doc_id, text and source are read.

    Groups in which fractions are settled hold one source and one power of two of size and are
    split to about ``group_rows`` documents, so a source with a third of all rows is spread like any
    other; each passes on a few open documents, and the last step goes from large to small ones.
    """
    sizes = durable(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    ))
    sources = durable(source_targets(sizes, weights, most))
    copies = durable(_copies(sizes, sources, seed, group_rows))
    same = _same(["doc_id", "source", "size"])
    rows = sizes.alias("l").join(copies.alias("r"), same, "left").select(
        "l.doc_id", "l.source", "l.size", F.coalesce("r.copies", F.lit(0)).alias("copies")
    )
    return rows.alias("l").join(sources.alias("r"), _same(["source"])).select(
        "l.doc_id", "l.source", "l.size", "r.source_size", "r.target", "l.copies",
        (F.col("l.copies") * F.col("l.size")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``."""
    taken = mix(docs, **options).select("doc_id", "source", "size", "copies").distinct()
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
    )
    return (
        rows.alias("l").join(taken.hint("shuffle_hash").alias("r"), _same(["doc_id", "source", "size"]))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        .select("row.*")
    )


def _same(columns: Sequence[str]) -> Column:
    both = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    out = both[0]
    for c in both[1:]:
        out = out & c
    return out


def _chance(seed: int, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "source_no", "size"), F.lit(1 << 53)) / float(1 << 53)


_STATE = "doc_id long, source string, source_no int, size long, words double, whole long, part double, chance double, class int, chunk long"


def _copies(sizes: DataFrame, sources: DataFrame, seed: int, group_rows: int) -> DataFrame:
    """doc_id, source, size, copies for every distinct document."""
    rate = F.col("r.target") / F.col("r.source_size")
    units = (
        sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).alias("l")
        .join(sources.alias("r"), _same(["source"]))
        .select(
            "l.doc_id", "l.source", "r.source_no", "l.size",
            (F.col("l.n") * F.col("l.size")).cast("double").alias("words"),
            F.when(F.col("r.source_size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"),
        )
        .withColumn("whole", F.floor(F.col("rate") + 1e-12))
        .withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
        .withColumn("part", F.when(F.col("part") < 1e-12, F.lit(0.0)).otherwise(F.col("part")))
        .withColumn("part", F.when(F.col("words") > 0, F.col("part")).otherwise(
            (_chance(seed, -1) < F.col("part")).cast("double")))
        .withColumn("class", F.floor(F.log2(F.greatest("words", F.lit(1.0)))).cast("int"))
        .drop("rate")
    )
    is_open = (F.col("part") > 0) & (F.col("part") < 1)
    waiting = durable(units)
    done = [waiting.where(~is_open)]
    waiting, level = waiting.where(is_open), 0
    keys = ["source_no", "class"]
    while True:
        width = waiting.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("chunks"))
        width, seen = durable(width, most=F.max("chunks"))
        last = (seen["most"] or 0) <= 1 and level > 0
        chunk = F.pmod(F.xxhash64(F.lit(level), "doc_id", "size"), F.col("chunks"))
        rows = waiting.join(width, keys).withColumn("chunk", chunk).withColumn("chance", _chance(seed, level))
        rows = rows.select(*[c.split()[0] for c in _STATE.split(", ")])
        group = ["source_no"] if last else [*keys, "chunk"]
        settled = durable(rows.groupBy(*group).applyInPandas(_settle_all if last else _settle_most, _STATE))
        done.append(settled.where(~is_open))
        if last:
            break
        waiting, level = settled.where(is_open).drop("chunk", "chance"), level + 1
    out = [d.select("doc_id", "source", "size", (F.col("whole") + F.col("part")).cast("long").alias("copies")) for d in done]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _settle_most(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["chance", "doc_id", "size"], ignore_index=True)
    return _settled(rows, max(0, len(rows) - _OPEN))


def _settle_all(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["words", "chance", "doc_id"], ascending=[False, True, True], ignore_index=True)
    want = (rows.words * rows.part).sum()
    rows = _settled(rows, len(rows))
    left = (rows.part > 0) & (rows.part < 1)
    rows.loc[left, "part"] = (rows.chance[left] < rows.part[left]).astype(float)
    rows["part"] = _balanced(rows.words.to_numpy(), rows.part.to_numpy(), want)
    return rows


def _balanced(words: np.ndarray, part: np.ndarray, want: float) -> np.ndarray:
    """Undo what rounding the last document has added or removed: turn over single documents, the
    large ones first, wherever that brings the words closer to what is wanted."""
    part, over = part.copy(), (words * part).sum() - want
    for i, w in enumerate(words):
        change = w if part[i] == 0 else -w
        if abs(over + change) < abs(over):
            part[i], over = 1 - part[i], over + change
    return part


def _settled(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    rows["part"] = pivot(rows.words.to_numpy(), rows.part.to_numpy(), rows.chance.to_numpy(), n)
    return rows


def pivot(words: np.ndarray, part: np.ndarray, chance: np.ndarray, n: int) -> np.ndarray:
    """Settle the first ``n`` fractions in order; at most one of them stays between 0 and 1."""
    w, p = words.tolist(), part.tolist()
    a = -1
    for b in range(n):
        if not 0 < p[b] < 1:
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - p[a]) * w[a], p[b] * w[b])  # most words that b can hand to a
        down = min(p[a] * w[a], (1 - p[b]) * w[b])
        move = up if chance[b] * (up + down) < down else -down
        p[a], p[b] = _snap(p[a] + move / w[a]), _snap(p[b] - move / w[b])
        a = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return np.array(p, float)


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
