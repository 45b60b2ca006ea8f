"""Language identification with a string kernel.

Texts are compared by the n-grams they have in common (a blended spectrum of one to three
characters, presence only, normalised). Nyström landmarks turn the kernel into features on which
one-versus-rest ridge regression is fitted. Scores are products of presence matrices with the
landmark matrix and the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from circdesk.llm.support import durable, pieces

UNKNOWN = "und"
BUCKETS = 1 << 16
LANDMARKS = 1024  # of all languages together, which bounds the matrices on the driver
_GRAMS = 3
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BATCH = 256


@dataclass(frozen=True)
class Model:
    """``weights`` holds, per n-gram bucket and language, the landmark matrix times the coefficients."""

    languages: tuple[str, ...]
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    """True for documents that must not be learned from; false for a null doc_id, never learned from either."""
    return F.coalesce(_rest(doc_id) == 2, F.lit(False))


def _rest(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(
    docs: DataFrame, texts_per_language: int = 300, landmarks_per_language: int = 64, ridge: float = 1e-3
) -> Model:
    """Learn from a bounded sample: at most ``texts_per_language`` labelled documents of each language.

    Documents are drawn by a hash of doc_id with a rate set from the counts per language; held-out
    documents, null languages and texts without letters are left out. What reaches the driver is the
    presence of n-grams in the sample. Each language has up to ``landmarks_per_language`` landmarks, fewer if
    there would be more than ``LANDMARKS`` in all. Without labelled documents the model knows no language.
    """
    labelled = docs.where(
        (_rest(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & has_letter(F.col("text"))
    ).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    # One row per language, from a file: Spark sees that it is small and need not shuffle the texts.
    rates = durable(labelled.groupBy("lang").agg((F.lit(2.0 * texts_per_language) / F.count(F.lit(1))).alias("rate")))
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = labelled.withColumn("draw", draw).join(rates, "lang").where("draw < rate")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= texts_per_language)
    rows = sample.select("lang", "place", "text").mapInArrow(
        _presence_rows, "lang string, place int, grams binary"
    ).toPandas().sort_values(["lang", "place"], ignore_index=True)
    return _solve(rows.lang.to_numpy(), rows.place.to_numpy(), [np.frombuffer(g, np.uint16) for g in rows.grams],
                  landmarks_per_language, ridge)


def _solve(lang: np.ndarray, place: np.ndarray, grams: list[np.ndarray], marks: int, ridge: float) -> Model:
    names = tuple(sorted(set(lang)))
    if not names:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    chosen = np.flatnonzero(place <= max(1, min(marks, LANDMARKS // len(names))))
    landmark = np.zeros((BUCKETS, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        landmark[grams[i], j] = 1 / np.sqrt(max(1, len(grams[i])))
    kernel = np.array([landmark[g].sum(0, dtype=np.float64) / np.sqrt(max(1, len(g))) for g in grams])
    value, vector = np.linalg.eigh(kernel[chosen])
    use = value > 1e-9 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    features = kernel @ root
    truth = (lang[:, None] == np.array(names)[None, :]).astype(float)
    size = np.array([max(1, (lang == x).sum()) for x in lang])
    even = len(lang) / (len(names) * size)  # every language weighs the same
    gram = features.T @ (features * even[:, None]) + ridge * len(lang) / len(names) * np.eye(use.sum())
    coefficients = root @ np.linalg.solve(gram, features.T @ (truth * even[:, None]))
    return Model(names, (landmark @ coefficients).astype(np.float32))


def classify(docs: DataFrame, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score in 0 to 1, and ``carry``.

    Only the whole text is looked at. A text that is null or has no letter gets ``und`` with score
    0, and so does every text if no language was learned. Equal texts get equal answers; of equal
    scores the first language by name wins. An empty table gives an empty result.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.when(has_letter(F.col("text")), F.col("text")).alias("text"),
        F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"),
    )
    out = T.StructType([
        source.schema["doc_id"], source.schema["held_out"], T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()), source.schema["carried"],
    ])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 buckets times the languages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _BATCH):
            names, scores = _scores(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()), batch.column("carried")],
                names=["doc_id", "held_out", "lang_pred", "score", "carried"],
            )

    kept = [c for c in carry if c not in ("doc_id", "held_out", "lang_pred", "score")]
    return source.mapInArrow(run, out).select(
        "doc_id", "held_out", "lang_pred", "score", *[F.col("carried").getField(c).alias(c) for c in kept]
    )


def _scores(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """A batch at once: the sparse presence matrix of its texts times the weights."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t]
    if not rows or not model.languages:
        return names, scores
    grams = [presence(texts[i]) for i in rows]
    starts = np.cumsum([0, *[len(g) for g in grams[:-1]]])
    sums = np.add.reduceat(model.weights[np.concatenate(grams)], starts, axis=0, dtype=np.float64)
    sums /= np.sqrt([len(g) for g in grams])[:, None]
    best = sums.argmax(1)
    for i, b, s in zip(rows, best, sums[np.arange(len(rows)), best]):
        names[i], scores[i] = model.languages[b], float(min(1.0, max(0.0, s)))
    return names, scores


def presence(text: str) -> np.ndarray:
    """The n-gram buckets that occur in a text, ascending."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = np.zeros(BUCKETS, bool)
    code = points
    for n in range(_GRAMS):
        if n:
            code = code[:-1] * np.uint64(0x1F123BB5) + points[n:]
        seen[(code * np.uint64(_MIX[n])) >> np.uint64(48)] = True
    return np.flatnonzero(seen)


def _presence_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, _BATCH):
        grams = [presence(t).astype(np.uint16).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("place"), pa.array(grams, pa.binary())],
            names=["lang", "place", "grams"],
        )
