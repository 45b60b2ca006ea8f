"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as word sequences; two lines match when one becomes the other by replacing,
inserting or deleting at most one word. Every line emits the sequences that are left when one word
is taken out, as hashed keys; equal keys meet in a join, the edit distance of what met is verified
on the words, and of matching lines the earliest stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from circdesk.llm.support import WORD, durable

MIN_WORDS = 5
_RANGE = 1 << 40  # keeps sums of hashes of even the longest line within a long


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs`` with a doc_id: doc_id, n_lines, n_removed, removed_lines.

    Lines end at a newline and are numbered from 0. A line is removed if a line before it (smaller
    doc_id, or the same document and a smaller number) has the same words, or differs in one word and
    both have ``min_words`` or more. Lines are judged on the input, not on what is left. Lines
    without words stay. Null texts have no lines, empty texts one. Rows with a null doc_id have no
    place in the order and are left out; repeated rows with one doc_id count as one document whose
    lines are the earliest of each number. An empty table gives an empty result. Only doc_id and text
    are read.

    Nothing but hashes is shuffled until a line is known to share half its words with a different
    line: one edit leaves the first or the second half of a line untouched. Copies of a line meet
    after a map-side combine, and joins take their other side from files, so that AQE can split a
    frequent key.
    """
    lines = _lines(docs, min_words)
    distinct = durable(
        lines.where("n > 0").groupBy("id1", "id2").agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"),
            F.first("halves").alias("halves"), F.first("n").alias("n"),
        )
    )
    near = durable(_near(docs, distinct, min_words))
    firsts = distinct.select("id1", "id2", "first").join(near, ["id1", "id2"], "left_anti")
    # What stays is the first occurrence of a line without an earlier neighbour.
    stays = firsts.select("first.doc_id", "first.line_no").withColumn("stays", F.lit(1))
    # Of repeated rows with one doc_id a line stays without words only if it has none in any of them.
    wordless = (~F.col("line").rlike(WORD)).cast("int")
    numbered = _numbered(docs).groupBy("doc_id", "line_no").agg(F.min(wordless).alias("stays"))
    marked = numbered.unionByName(stays).groupBy("doc_id", "line_no").agg(F.max("stays").alias("stays"))
    counted = marked.groupBy("doc_id").agg(
        F.count_if(F.col("line_no") >= 0).alias("n_lines"),
        F.count_if((F.col("line_no") >= 0) & (F.col("stays") == 0)).alias("n_removed"),
        F.sort_array(F.collect_list(F.when((F.col("line_no") >= 0) & (F.col("stays") == 0), F.col("line_no")))).alias("removed_lines"),
    )
    return counted.select("doc_id", "n_lines", "n_removed", "removed_lines")


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and line; line_no -1 for a null text."""
    return docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.posexplode(F.coalesce(F.split("text", "\n", -1), F.array(F.lit("")))).alias("line_no", "line"),
        F.col("text").isNull().alias("none"),
    ).select("doc_id", F.when(F.col("none"), F.lit(-1)).otherwise(F.col("line_no")).alias("line_no"), "line")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, line_no, n words, id1, id2, halves; line_no -1 for a null text."""
    rows = _numbered(docs).withColumn("words", _words(F.col("line")))
    n = F.size("words")
    half = F.expr("n div 2")
    rows = rows.withColumn("n", n)
    return rows.select(
        "doc_id", "line_no", "n",
        F.xxhash64("words").alias("id1"), F.xxhash64(F.lit(1), F.col("words")).alias("id2"),
        # Halves of the line itself, and of a line one word shorter: the same key in both lines.
        F.when(n >= min_words, F.array_distinct(F.array(
            F.xxhash64(F.lit(2), F.slice("words", 1, half)),
            F.xxhash64(F.lit(2), F.slice("words", 1, F.expr("(n - 1) div 2"))),
            F.xxhash64(F.lit(3), F.slice("words", F.expr("n div 2 + 1"), F.col("n"))),
            F.xxhash64(F.lit(3), F.slice("words", F.expr("(n - 1) div 2 + 2"), F.col("n"))),
        ))).alias("halves"),
    )


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _near(docs: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """id1, id2 of distinct lines with an earlier line one edit away."""
    long_ = distinct.where(F.col("n") >= min_words)
    keys = long_.select(F.explode("halves").alias("half"), "id1", "id2", "n")
    shared = durable(keys.groupBy("half").agg(F.min("id1").alias("a"), F.max("id1").alias("b")).where("a <> b").select("half"))
    wanted = keys.join(shared, "half", "left_semi").select("id1", "id2").distinct()
    wanted = wanted.join(distinct, ["id1", "id2"]).select("first", "id1", "id2", "n")
    by_doc = durable(wanted.groupBy("first.doc_id").agg(
        F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "id1", "id2")).alias("wanted")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", "\n", -1).alias("lines"))
    lines = durable(
        texts.join(by_doc, "doc_id").select("doc_id", "lines", F.explode("wanted").alias("w"))
        .select("doc_id", "w.line_no", "w.id1", "w.id2", _words(F.get("lines", F.col("w.line_no"))).alias("words"))
        .where((F.xxhash64("words") == F.col("id1")) & (F.xxhash64(F.lit(1), F.col("words")) == F.col("id2")))
        .dropDuplicates(["doc_id", "line_no"])
    )
    variants = durable(_variants(lines))
    # A replaced word: the same words are left when the same place is taken out.
    replaced = variants.where("taken > 0")
    groups = durable(_groups(replaced, ["taken", "v1", "v2"]))
    a = _later(replaced.join(groups, ["taken", "v1", "v2"]))
    # An inserted word: what is left is the other line as it is.
    whole = variants.where("taken = 0").drop("taken")
    left_over = replaced.drop("taken")
    shorter = durable(_meeting(whole, left_over))
    b = _later(left_over.join(shorter.select("v1", "v2", F.col("whole").alias("earliest")), ["v1", "v2"]))
    c = _later(whole.join(shorter.select("v1", "v2", F.col("rest").alias("earliest")), ["v1", "v2"]))
    met = a.unionByName(b).unionByName(c).groupBy("doc_id", "line_no").agg(F.min("earliest").alias("earliest"))
    met = durable(met)
    other = lines.select(F.struct("doc_id", "line_no").alias("earliest"), F.col("words").alias("earlier_words"))
    return (
        lines.join(met, ["doc_id", "line_no"]).join(other, "earliest")
        .where(_one_edit(F.col("words"), F.col("earlier_words"))).select("id1", "id2")
    )


def _variants(lines: DataFrame) -> DataFrame:
    """A line's own key (``taken`` 0) and, for each word, the key of the line without it.

    A key is a sum of hashes of (word, place), so that all variants of a line come from running
    sums in time proportional to its length. v1 and v2 are two such sums of 40-bit hashes.
    """
    def sums(place: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), place, F.col("word")), F.lit(_RANGE))

    words = lines.select("doc_id", "line_no", F.posexplode("words").alias("place", "word"))
    line = Window.partitionBy("doc_id", "line_no").orderBy("place")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(1, Window.unboundedFollowing)
    one_less = F.col("place") - 1
    kept = words.select(
        "doc_id", "line_no", "place",
        *[(F.coalesce(F.sum(sums(F.col("place"), s)).over(before), F.lit(0))
           + F.coalesce(F.sum(sums(one_less, s)).over(after), F.lit(0))).alias(f"v{s}") for s in (1, 2)],
        *[sums(F.col("place"), s).alias(f"s{s}") for s in (1, 2)],
    )
    whole = words.groupBy("doc_id", "line_no").agg(*[F.sum(sums(F.col("place"), s)).alias(f"v{s}") for s in (1, 2)])
    return kept.select("doc_id", "line_no", (F.col("place") + 1).alias("taken"), "v1", "v2").unionByName(
        whole.select("doc_id", "line_no", F.lit(0).alias("taken"), "v1", "v2")
    )


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min(F.struct("doc_id", "line_no")).alias("earliest"), F.count(F.lit(1)).alias("many")
    ).where("many > 1").drop("many")


def _meeting(whole: DataFrame, left_over: DataFrame) -> DataFrame:
    """The earliest whole line and the earliest line with one word more, where both occur."""
    sides = whole.withColumn("is_whole", F.lit(True)).unionByName(left_over.withColumn("is_whole", F.lit(False)))
    first = F.struct("doc_id", "line_no")
    return sides.groupBy("v1", "v2").agg(
        F.min(F.when(F.col("is_whole"), first)).alias("whole"), F.min(F.when(~F.col("is_whole"), first)).alias("rest")
    ).where("whole is not null and rest is not null")


def _later(met: DataFrame) -> DataFrame:
    return met.where(F.col("earliest") < F.struct("doc_id", "line_no")).select("doc_id", "line_no", "earliest")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one edit apart: behind their common start, the rest of
    both, or of both but for one word of the longer or of each, is equal."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False))))
    start = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    rest_a, rest_b = F.slice(a, start + 1, F.size(a)), F.slice(b, start + 1, F.size(b))
    from_a, from_b = F.slice(a, start, F.size(a)), F.slice(b, start, F.size(b))
    return (start == 0) & (F.size(a) == F.size(b)) & (same == F.size(a)) | (start > 0) & (
        ((F.size(a) == F.size(b)) & (rest_a == rest_b))
        | ((F.size(a) == F.size(b) + 1) & (rest_a == from_b))
        | ((F.size(b) == F.size(a) + 1) & (rest_b == from_a))
    )
