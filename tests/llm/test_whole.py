"""Operators of training data read whole clauses and learn all languages."""

import random
import time

from kinetrail.llm import language, toxicity

from .fixtures import documents


def outcomes(text):
    return [x for _, found in toxicity.ToxicityModel().clauses(text) for x in found]


def test_clauses_without_end_marks_are_read_whole():
    gap = "word " * 200
    assert outcomes("you " + gap + "idiot") == ["aimed"]
    assert outcomes("he said " + gap + "she is a moron") == ["reported"]
    assert outcomes("kill " + gap + "you") == ["threat"]
    assert outcomes("not " + gap + "stupid " + gap + "moron") == ["denied", "bare"]
    for shift in range(12):  # a second match anywhere around 400 characters behind the first
        assert outcomes("idiot " + "x" * (380 + shift) + " worthless scum") == ["bare"] * 3
    assert outcomes("You. " + gap + "idiot. moron! not dumb") == ["bare", "bare", "denied"]


def test_long_texts_without_end_marks_cost_one_pass():
    began = time.process_time()
    assert len(outcomes("idiot and word " * 40_000)) == 40_000
    assert len(outcomes("idiot. and word " * 40_000)) == 40_000
    assert time.process_time() - began < 20


def test_every_language_is_learned(spark):
    draw, texts, langs = random.Random(8), [], []
    for k in range(70):
        words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)]
        for _ in range(12 if k < 64 else 10):  # the last six are the rarest
            texts.append(" ".join(draw.choices(words, k=24)))
            langs.append(f"l{k:02}")
    docs = documents(spark, texts, langs)
    fitted = language.fit(docs)
    assert len(fitted.langs) == 70
    out = {r.doc_id: r.lang_pred for r in language.predict_languages(docs, fitted).collect()}
    rare = [i for i, x in enumerate(langs) if x >= "l64"]
    assert sum(out[i] == langs[i] for i in rare) >= 0.9 * len(rare)
