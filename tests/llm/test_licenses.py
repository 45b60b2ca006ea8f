import math
import random
import re

from circdesk.llm.licenses import BASE, SHARE, SLACK, TEMPLATES, scan_licenses
from circdesk.llm.support import table
from tests.llm.cases import awkward_rows, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _stands(words, phrase, low=0, high=None):
    n, high = len(phrase), len(words) if high is None else high
    return [i for i in range(max(0, low), min(high, len(words)) - n + 1) if words[i: i + n] == phrase]


def _plain(texts):
    """Every template at every place of every text."""
    split = [_words(t) for t in texts]
    seen = [set(w) for w in split]
    idf = {}
    for text in [t[1] for t in TEMPLATES] + [b[0] for b in BASE]:
        for w in text.split():
            idf[w] = math.log((len(texts) + 1) / (sum(w in s for s in seen) + 1)) + 1
    out = []
    for words in split:
        base = [(p, i, label) for p, label in BASE for i in _stands(words, p.split())]
        labels, score = {x[2] for x in base}, 1.0 if base else 0.0
        at = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        for label, text, needed in TEMPLATES:
            t = text.split()
            if any(not _stands(words, n.split()) for n in needed):
                continue
            total = sum(idf[w] for w in t)
            for i in range(-len(t), len(words)):
                kept = sum(idf[w] for q, w in enumerate(t) if any(abs(p - i - q) <= SLACK for p in at.get(w, [])))
                if kept >= SHARE * total * (1 - 1e-9) and all(
                        _stands(words, n.split(), i - SLACK, i + len(t) + SLACK) for n in needed):
                    labels.add(label)
                    score = max(score, kept / total)
        starts = [x[1] for x in base]
        out.append((len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted({x[2] for x in base})), ",".join(sorted(labels)), round(score, 9)))
    return out


def _got(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)))
            for r in df.collect()]


def _texts():
    draw = random.Random(8)
    out = ["Under the MIT License. under the mit license", "CC BY-NC 4.0", "cc by nc cc by nc", "Apache License, Version 2.0",
           "under the mité license", "UNDER_THE_MIT_LICENSE", "license " * 3000, "mit " * 50, "under the mit"]
    for _ in range(250):
        _, text, _ = draw.choice(TEMPLATES)
        words = text.split()
        for _ in range(draw.randint(0, 4)):  # words lost, changed, put in
            i = draw.randrange(len(words))
            words[i: i + draw.randint(0, 1)] = draw.choice([[], ["foo"], [draw.choice(words)], ["2024", "someone"]])
        front = [draw.choice(["the", "a", "public", "version", "lorem"]) for _ in range(draw.randint(0, 20))]
        out.append(draw.choice([" ", ", ", "\n"]).join([*front, *words, *front]).title())
    return out


def test_like_plain_search(spark):
    texts = _texts()
    got = _got(scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    want = _plain(texts)
    assert dict(got) == dict(enumerate(want))
    assert sum(bool(w[5]) for w in want) > 50 and sum(not w[5] for w in want) > 50


def test_test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = docs.collect()
    got = dict(_got(scan_licenses(docs)))
    for r, want in zip(rows, _plain([r.text for r in rows])):
        assert got[r.doc_id] == want
        assert bool(want[5]) == bool(re.search("(?i)licensed under|released under the mit", r.text or ""))


def test_awkward_rows(awkward, nothing):
    got = _got(scan_licenses(awkward))
    rows = documents(awkward_rows())
    key = lambda r: (str(r[0]), r[1][0])
    assert sorted(got, key=key) == sorted(zip([r[0] for r in rows], _plain([r[1] for r in rows])), key=key)
    assert scan_licenses(nothing).collect() == []
