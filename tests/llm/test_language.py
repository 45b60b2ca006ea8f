import math
import zlib

import numpy as np
import pytest

from circdesk.llm.language import _scores, _solve, classify, fit, presence
from circdesk.llm.support import table
from tests.conftest import SMALL
from tests.llm.cases import awkward_rows


@pytest.fixture(scope="module")
def model(spark):
    return fit(table(spark, "/root/testdata/sf0.01", "documents"), texts_per_language=60, landmarks_per_language=20)


def test_held_out_accuracy(spark, model):
    rows = classify(table(spark, "/root/testdata/sf0.01", "documents"), model, carry=["lang"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 200 and sum(r.lang_pred == r.lang for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)


def _grams(text):
    t = text.lower()
    return {t[i: i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_like_the_kernel_written_out(spark):
    """Landmarks, features and ridge regression over sets of substrings, without hashing."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").where("lang is not null and length(text) > 200").orderBy("doc_id")
    rows = rows.select("text", "lang").limit(260).collect()
    learn, unseen, ridge = rows[:160], rows[160:], 1e-3
    lang = np.array([r.lang for r in learn])
    place = np.array([list(lang[: i + 1]).count(x) for i, x in enumerate(lang)])
    model = _solve(lang, place, [presence(r.text) for r in learn], 12, ridge)
    ours, scores = _scores([r.text for r in unseen], model)

    sets, marks = [_grams(r.text) for r in learn], np.flatnonzero(place <= 12)
    kernel = lambda a, b: np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    landmarks = [sets[i] for i in marks]
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks))
    root = vector / np.sqrt(value)
    names = sorted(set(lang))
    weight = np.array([len(lang) / (len(names) * (lang == x).sum()) for x in lang])
    features = kernel(sets, landmarks) @ root
    truth = (lang[:, None] == np.array(names)) * 1.0
    solved = np.linalg.solve(features.T @ (features * weight[:, None]) + ridge * len(lang) / len(names) * np.eye(len(value)),
                             features.T @ (truth * weight[:, None]))
    want = kernel([_grams(r.text) for r in unseen], landmarks) @ root @ solved
    assert list(model.languages) == names
    assert np.mean(np.array(ours) == np.array(names)[want.argmax(1)]) >= 0.98
    assert np.abs(np.clip(want.max(1), 0, 1) - scores).mean() < 0.02  # n-grams that share a bucket


def test_many_languages_stay_within_the_landmarks():
    lang = np.array([f"l{i % 300:03d}" for i in range(1200)])
    place = np.array([i // 300 + 1 for i in range(1200)])
    draw = np.random.default_rng(2)
    grams = [np.unique(np.concatenate([draw.integers(0, 65_536, 20), np.arange(200 * (i % 300), 200 * (i % 300) + 50)])) for i in range(1200)]
    model = _solve(lang, place, grams, 64, 1e-3)
    assert len(model.languages) == 300 and model.weights.shape == (65_536, 300)


def test_awkward_rows(awkward, nothing, model):
    rows = classify(awkward, model, carry=["kept", "lang"]).collect()
    assert len(rows) == len(awkward_rows()) and {r.kept for r in rows} == {"x"}
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 12, 14):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[10].lang_pred in model.languages and by_id[None].held_out is False
    assert classify(nothing, model).collect() == []


def test_nothing_to_learn_from(awkward, nothing):
    empty = fit(nothing)
    assert {r.lang_pred for r in classify(awkward, empty).collect()} == {"und"}


def test_a_prediction_depends_on_the_text_only(spark, model):
    docs = table(spark, SMALL, "documents").limit(50)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in classify(docs, model).collect()}
    other = docs.selectExpr("doc_id + 1000000 doc_id", "text", "'xx' lang", "'?' source")
    assert {r.doc_id - 1_000_000: (r.lang_pred, r.score) for r in classify(other, model).collect()} == plain
