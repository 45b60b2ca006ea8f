"""Licence notices in texts, through a positional index of rare words.

A template is a licence's wording. Its words are looked up in the text by how rare they are in the
whole corpus: a notice that keeps a given share of a template's weight must hold one of its rarest
words, so only those are indexed, with their places in the template. A place of such a word in the
text and its place in the template give the place of the whole notice; there the other words are
compared, and the phrases that the licence cannot do without are verified.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from circdesk.llm.support import pieces

# The phrases that count as base places, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Fixed values: (label, wording, phrases that must occur in it word for word).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
     " associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in"
     " compliance with the license", ("apache license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
     " that the following conditions are met", ("redistribution and use", "conditions are met")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2",
     ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is"
     " hereby granted", ("permission to use copy modify", "is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights",
     ("waived all copyright",)),
)

SHARE = 0.85  # of a template's weight that a notice must keep
SLACK = 2  # words by which a word may be off its place

# A word is a run of ASCII letters and digits and of everything beyond ASCII; letters are lower-cased.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def text_words(text: str | None) -> list[bytes]:
    """The words of a whole text in UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


Template = tuple[str, str, Sequence[str]]


@dataclass(frozen=True)
class _Wording:
    label: str
    words: tuple[bytes, ...]
    places: tuple[tuple[float, int, bytes], ...]  # weight, place and word, heaviest first
    needed: tuple[tuple[bytes, ...], ...]
    total: float
    spare: float  # weight that a notice may lack
    slack: int
    base: bool

    def share(self, at: int, places: dict[bytes, list[int]]) -> float | None:
        """The share of the weight that stands at a place of a text; None if it is too little."""
        lacking = 0.0
        for weight, q, word in self.places:
            if not _near(places.get(word, ()), at + q, self.slack):
                lacking += weight
                if lacking > self.spare:
                    return None
        return 1 - lacking / self.total


class Index:
    """Postings (template, place in it, or up to ``slack`` words off) of every template's rarest words."""

    def __init__(self, templates: Sequence[Template], base: Sequence[tuple[str, str]], idf: dict[bytes, float],
                 share: float, slack: int) -> None:
        self.wordings: list[_Wording] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, text, needed in templates:
            self._add(label, text, needed, share, slack, False, idf)
        for text, label in base:
            self._add(label, text, (text,), 1.0, 0, True, idf)
        self.vocabulary = {w for t in self.wordings for w in t.words}

    def _add(self, label: str, text: str, needed: Sequence[str], share: float, slack: int, base: bool,
             idf: dict[bytes, float]) -> None:
        words = tuple(text_words(text))
        weights = [idf[w] for w in words]
        total = sum(weights)
        spare = total * (1 - share) * (1 + 1e-9)
        number = len(self.wordings)
        places = tuple(sorted(((x, q, w) for q, (w, x) in enumerate(zip(words, weights))), reverse=True))
        self.wordings.append(_Wording(
            label, words, places, tuple(tuple(text_words(n)) for n in needed), total, spare, slack, base))
        # Rarest first. A notice without any of them would lack more than it may once they outweigh ``spare``.
        posted = 0.0
        for word in sorted(set(words), key=lambda w: (-idf[w], w)):
            if posted > spare:
                break
            own = [q for q, w in enumerate(words) if w == word]
            self.postings[word] += [(number, q + off) for q in own for off in range(-slack, slack + 1)]
            posted += len(own) * idf[word]

    def notices(self, words: list[bytes]) -> Iterator[tuple[_Wording, int, float]]:
        """(template, place, share of its weight) of every notice; a base phrase once for each place."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, word in enumerate(words):
            if word in self.vocabulary:
                places[word].append(p)
        found = {(t, p - q) for word in places.keys() & self.postings.keys()
                 for t, q in self.postings[word] for p in places[word]}
        for t, at in found:
            wording = self.wordings[t]
            if wording.base:
                if at >= 0 and tuple(words[at: at + len(wording.words)]) == wording.words:
                    yield wording, at, 1.0
                continue
            share = wording.share(at, places)
            if share is not None:
                low, high = at - wording.slack, at + len(wording.words) + wording.slack
                if all(_stands(words, places, phrase, low, high) for phrase in wording.needed):
                    yield wording, at, share


def _near(places: Sequence[int], at: int, slack: int) -> bool:
    i = bisect_left(places, at - slack)
    return i < len(places) and places[i] <= at + slack


def _stands(words: list[bytes], places: dict[bytes, list[int]], phrase: tuple[bytes, ...], low: int, high: int) -> bool:
    """Whether the phrase's words stand consecutively between two places."""
    first = places.get(phrase[0], [])
    for i in range(bisect_left(first, low), len(first)):
        if first[i] + len(phrase) > high:
            break
        if tuple(words[first[i]: first[i] + len(phrase)]) == phrase:
            return True
    return False


def scan_licenses(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE,
    share: float = SHARE, slack: int = SLACK,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, one row per row.

    ``n_base`` counts the places where a base phrase's words stand consecutively, ``first_word`` and
    ``last_word`` are the smallest and largest of them (null without any). ``labels`` adds those of
    templates of which a notice keeps ``share`` of the weight, each word at most ``slack`` words off
    its place, and all needed phrases word for word. ``score`` is the largest share found, 0 without
    labels. Labels are distinct, sorted and joined by commas; a null or empty text has none and no
    words. Whole texts are read, whatever their length; equal texts get equal answers, repeated rows
    and null doc_ids one row each. An empty table gives an empty result. Other columns are not read.

    The words' weights come from all documents: two passes over the texts, between which one count
    per word of the templates reaches the driver.
    """
    idf = word_weights(docs, [w for _, text, _ in templates for w in text_words(text)]
                       + [w for text, _ in base for w in text_words(text)])
    index = Index(templates, base, idf, share, slack)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # as large as the templates
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 500):
            out = [_answer(shared.value, text_words(t.as_py())) for t in batch.column("text")]
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _answer(index: Index, words: list[bytes]) -> tuple:
    base, labels, base_labels, score = set(), set(), set(), 0.0
    for wording, at, share in index.notices(words):
        labels.add(wording.label)
        score = max(score, share)
        if wording.base:
            base.add((wording.words, at))
            base_labels.add(wording.label)
    starts = [at for _, at in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


def word_weights(docs: DataFrame, words: Iterable[bytes]) -> dict[bytes, float]:
    """Inverse document frequency of the given words over all documents; positive, largest for unseen words."""
    wanted = sorted(set(words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, rows = set(wanted), dict.fromkeys(wanted, 0), 0
        for batch in pieces(batches, 500):
            rows += batch.num_rows
            for text in batch.column("text"):
                for word in known.intersection(text_words(text.as_py())):
                    seen[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *wanted], pa.binary()), pa.array([rows, *seen.values()], pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {None if r.word is None else bytes(r.word): r.n for r in counts.collect()}  # one row per template word
    rows = found.get(None, 0)
    return {w: math.log((rows + 1) / (found.get(w, 0) + 1)) + 1 for w in wanted}
