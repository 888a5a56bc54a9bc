"""Language, quality and toxicity on small corpora with known answers."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import language, quality, toxicity
from kinetrail.llm.common import fold

from .fixtures import AWKWARD, documents, words

EN = "the of and to in is that it was for on with as are this be at by from or an".split()
DE = "der die und das ist nicht ein zu von mit sich auf für dem auch wird werden haben über".split()
FR = "le la les des est une pour dans que qui sur avec pas plus ce être vous été aux où".split()


def text_in(draw, vocabulary, n=40):
    return " ".join(draw.choice(vocabulary) + draw.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    draw = random.Random(1)
    rows = [(text_in(draw, v), k) for k, v in (("en", EN), ("de", DE), ("fr", FR)) for _ in range(60)]
    return language.train([t for t, _ in rows], [k for _, k in rows])


def test_languages_of_whole_texts(model):
    draw = random.Random(2)
    for k, v in (("en", EN), ("de", DE), ("fr", FR)):
        got, score = model.predict([text_in(draw, v, n) for n in (1, 5, 200, 3000)])
        assert got == [k] * 4 and all(0 <= s <= 1 for s in score)


def test_words_of_code_switched_text(model):
    draw = random.Random(3)
    parts = [("en", EN), ("de", DE), ("fr", FR)]
    words_, want = [], []
    for k, v in parts:
        words_ += [draw.choice(v) for _ in range(15)]
        want += [k] * 15
    got = [k for _, k, _ in model.label_words(" ".join(words_))]
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.9
    assert model.label_words("") == [] and model.label_words("12 ?!") == []


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(4)
    emit, a, first = draw.uniform(0.1, 1, (7, 3)).astype("f4"), draw.uniform(0.1, 1, (3, 3)), draw.uniform(0.1, 1, 3)
    got = language.marginals(emit, np.array([5, 2]), a, first)
    for begin, n in ((0, 5), (5, 2)):
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=n):
            p = first[path[0]] * np.prod([emit[begin + i, s] for i, s in enumerate(path)]) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
            for i, s in enumerate(path):
                want[i, s] += p
        assert np.allclose(got[begin : begin + n], want / want.sum(1, keepdims=True), atol=1e-5)


def one_recursion(emit, a, first):
    """Forward-backward over a whole text, word by word."""
    alpha, beta = np.empty_like(emit, dtype="f8"), np.ones_like(emit, dtype="f8")
    for t, e in enumerate(emit.astype("f8")):
        alpha[t] = (first if t == 0 else alpha[t - 1] @ a) * e
        alpha[t] /= alpha[t].sum()
    for t in range(len(emit) - 2, -1, -1):
        beta[t] = a @ (emit[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    out = alpha * beta
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("n, sizes", [(3, [300, 64, 0, 1, 129, 65, 10_000]), (20, [200, 7])])
def test_long_texts_are_one_chain(n, sizes):
    draw = np.random.default_rng(12)
    emit = draw.uniform(0.05, 1, (sum(sizes), n)).astype("f4") ** 3
    a, first = np.exp(3 * np.eye(n)) * draw.uniform(0.2, 1, (n, n)), draw.uniform(0.1, 1, n)
    got, at = language.marginals(emit, np.array(sizes), a, first), 0
    for size in sizes:
        if size:
            assert np.allclose(got[at : at + size], one_recursion(emit[at : at + size], a, first), atol=2e-5)
        at += size


def test_words_of_long_code_switched_text(model):
    draw = random.Random(13)
    split = [draw.choice(v) for i in range(200) for v in [(EN, DE, FR)[i % 3]] for _ in range(50)]
    got = model.label_words(" ".join(split))
    rows, table = model.emissions([split])
    want = one_recursion(table[rows[0]], np.exp(model.transitions), np.exp(model.first))
    assert len(got) == 10_000
    assert np.allclose([g for _, _, g in got], want.max(1), atol=1e-4)


def test_tokens_are_whole_words(model):
    long = "x" * 5000
    assert len(model.label_words(f"the {long} of")) == 3
    assert long not in model._cache and "the" in model._cache


def test_fit_reads_whole_rows_and_repeated_ids_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, labels: seen.append(sorted(texts)))
    docs = documents(spark, ["a" * 90, "b" * 60, "c" * 30, "d" * 500, "e", "e2"], ["en"] * 6, [1, 2, 3, 4, 5, 5])
    language.fit(docs, chars=200)
    assert len(seen[0]) == 4 and "d" * 500 not in seen[0] and "e" in seen[0]
    language.fit(docs, per_lang=2, chars=10_000)
    assert len(seen[1]) == 2


def test_language_of_awkward_texts(spark):
    draw = random.Random(5)
    texts = [text_in(draw, v) for v in (EN, DE) for _ in range(30)] + AWKWARD
    langs = ["en"] * 30 + ["de"] * 30 + [None] * len(AWKWARD)
    docs = documents(spark, texts, langs)
    fitted = language.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = {r.doc_id: r for r in language.predict_languages(docs, fitted).collect()}
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out.values())
    for i, t in enumerate(texts):
        assert (out[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        if i < 60:
            assert out[i].lang_pred == langs[i]
    nothing = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.predict_languages(docs, nothing).collect()} == {"und"}
    assert language.predict_languages(docs.where("false"), fitted).count() == 0


def corpus(draw, n=240):
    texts, quality_, toxic = [], [], []
    for i in range(n):
        t = text_in(draw, EN, draw.randint(30, 120))
        bad = i % 3 == 0
        if bad:
            t = [lambda: t.upper().replace(" ", "!! "), lambda: " ".join(w + draw.choice(["$$$", "&&&", "###"]) for w in t.split()), lambda: " ".join(w for w in t.split()[:6] for _ in range(20))][i // 3 % 3]()
        mean = i % 4 == 1
        if mean:
            w = t.split()
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(["idiot", "scum", "worthless"]))
            t = " ".join(w)
        texts.append(t)
        quality_.append(int(not bad))
        toxic.append(int(mean))
    return texts, quality_, toxic


def test_quality_on_held_out_rows(spark):
    texts, label, _ = corpus(random.Random(6))
    docs = documents(spark, texts + AWKWARD)
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    fitted = quality.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    rows = docs.select("doc_id", fold(F.col("doc_id"), 4).alias("f"), quality.score_column(docs, fitted, F.col("text")).alias("s")).collect()
    assert len(rows) == len(texts) + len(AWKWARD) and all(0 <= r.s <= 1 for r in rows)
    held = [r for r in rows if r.f == 2 and r.doc_id < len(texts)]
    assert np.mean([(r.s >= 0.7) == label[r.doc_id] for r in held]) > 0.95


def test_quality_without_labels(spark):
    docs = documents(spark, ["some text", None])
    none = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    fitted = quality.fit(docs, none)
    assert [r.s for r in docs.select(quality.score_column(docs, fitted, F.col("text")).alias("s")).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(0, 1), (0, 1)], "doc_id long, quality int")
    assert quality.fit(docs, ones).constant == 1.0


def test_isotonic_is_monotone_and_the_least_squares_fit():
    draw = np.random.default_rng(7)
    raw = np.round(draw.uniform(0, 1, 200), 2)
    y = (draw.uniform(0, 1, 200) < raw).astype(float)
    knots, values = quality.isotonic(raw, y)
    fit = np.interp(raw, knots, values)
    assert (np.diff(values) >= -1e-12).all() and fit.mean() == pytest.approx(y.mean())
    best = ((fit - y) ** 2).sum()
    for _ in range(200):
        other = np.sort(draw.uniform(0, 1, 101))[np.round(raw * 100).astype(int)]
        assert ((other - y) ** 2).sum() >= best - 1e-9


def test_fourier_features_approximate_the_kernel():
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (30, 5))
    w, b = draw.standard_normal((5, 20000)), draw.uniform(0, 2 * np.pi, 20000)
    z = quality.fourier(x, np.zeros(5), np.ones(5), w, b)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    assert np.abs(z @ z.T - want).max() < 0.05


def test_statistics_of_any_text():
    for t in AWKWARD:
        assert np.isfinite(quality.statistics(t or "")).all()


def outcomes(text, **options):
    return [x for _, found in toxicity.ToxicityModel(**options).clauses(text) for x in found]


def test_grammar_outcomes():
    assert outcomes("You are an idiot.") == ["aimed"]
    assert outcomes("What an idiot") == ["bare"]
    assert outcomes("He is not stupid") == ["denied"]
    assert outcomes("She said that the man was a moron") == ["reported"]
    assert outcomes("I will kill you") == ["threat"]
    assert outcomes("you I will destroy!") == ["threat"]
    assert outcomes("I will not kill you") == ["threat_denied"]
    assert outcomes("I kill time. The weather is fine for you.") == []
    assert outcomes("not here. idiot there") == ["bare"]
    assert outcomes("losers's idiotic clownish trashcan") in (["bare"], [])
    assert outcomes("IDIOT!!! scum### (trash)") == ["bare"] * 3
    assert outcomes("") == [] and outcomes("perfectly nice words for you") == []


def interpreted(words_, model):
    """(outcomes, weight) of a clause by plain rules, word after word."""
    denied = reported = aimed = threatened = False
    out, weight, last = [], 0.0, None
    for word in words_:
        kind = next((k for k, names in toxicity.LEXICON.items() if word in names), None)
        stem = next((s for s in model.stems if word.startswith(s)), None)
        if kind is None and stem:
            kind = "C"
        said, w = None, 0.0
        if kind == "R":
            reported = True
        elif kind == "N":
            denied = not denied
        elif kind == "Y":
            if threatened:
                said, w = "threat", toxicity.HARM
            aimed, threatened = True, False
        elif kind in ("I", "C"):
            base = model.stems[stem] if kind == "C" else model.learned.get(word, toxicity.WORD)
            if reported:
                said, w = "reported", base + toxicity.REPORTED
            elif denied:
                said, w, denied = "denied", base + toxicity.DENIED, False
            elif kind == "C":
                said, w = "coded", base
            else:
                said, w = ("aimed", base + toxicity.AIMED) if aimed else ("bare", base)
        elif kind == "T":
            if reported:
                said, w = "reported", toxicity.HARM + toxicity.REPORTED
            elif denied:
                said, w, denied = "threat_denied", toxicity.HARM + toxicity.DENIED, False
            elif aimed:
                said, w = "threat", toxicity.HARM
            else:
                threatened = True
        if said:
            out.append(said)
            weight += 0.0 if word == last else w
            last = word
    return out, weight


def test_composed_machine_equals_a_plain_interpreter():
    draw = random.Random(21)
    model = toxicity.ToxicityModel(learned={"ugly": 0.7}, stems={"qqr": 1.9, "zorb": 2.5})
    some = {k: [w for w in names if w.isascii()][:6] for k, names in toxicity.LEXICON.items()} | {"C": ["qqrxa", "zorblax"], "-": ["table", "fine"], "u": ["ugly"]}
    for _ in range(3000):
        clause = [draw.choice(some[draw.choice(list(some))]) for _ in range(draw.randint(1, 14))]
        want, weight = interpreted(clause, model)
        found = model.paths(" ".join(clause))
        assert len(found) <= 1
        got = found[0] if found else (0, 0, 0.0, [])
        assert [x for x, _ in got[3]] == want and got[2] == pytest.approx(weight)


def test_documents_are_scored_by_clause_weights():
    model = toxicity.ToxicityModel()
    at = lambda t: model.score([t])[0]
    assert at("you are an idiot") > at("what an idiot") > at("he is not an idiot") > at("a fine day")
    assert at("he is not an idiot") < 0.3 and at("they said he was a moron") < 0.3 < at("i will kill you")
    assert at("idiot " * 5) == pytest.approx(at("idiot and and and and "), abs=0.01)  # repetition adds nothing


def test_common_insults_weigh_less():
    texts, y = ["the ugly duckling and an idiot"] * 3 + ["ugly weather"] * 40 + ["you idiot"] * 20, [1.0] * 3 + [0.0] * 40 + [1.0] * 20
    learned = toxicity.learn_insults(texts, y)
    assert set(learned) == {"ugly"} and learned["ugly"] < 0.5


def test_fits_of_awkward_tables(spark):
    docs = documents(spark, ["you idiot"] * 6 + ["a fine day"] * 6 + ["x", "y"], ids=[*range(12), 3, None])
    labels = spark.createDataFrame([(i, int(i < 6), int(i >= 6)) for i in range(12)] + [(2, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 0)], "doc_id long, toxic int, quality int")
    rows = quality.sample_labelled(docs, labels, "toxic", 100).collect()
    assert sorted(r["__key"] for r in rows) == [0, 1, 3, 3, 4, 5, *range(6, 12)]  # 2 is labelled both ways
    assert len(quality.sample_labelled(docs, labels, "toxic", 4).collect()) in (4, 5)
    for fit, column in ((toxicity.fit, "toxic"), (quality.fit, "quality")):
        for d, l in ((docs, labels), (docs.where("false"), labels), (docs, labels.where("false"))):
            scores = docs.select(quality.score_column(docs, fit(d, l), F.col("text")).alias("s")).collect()
            assert len(scores) == 14 and all(0 <= r.s <= 1 for r in scores)
            assert docs.where("false").select(quality.score_column(docs, fit(d, l), F.col("text"))).count() == 0


def test_ridge_from_partition_sums_equals_one_solve(spark):
    texts, label, _ = corpus(random.Random(30), 120)
    docs = documents(spark, texts).repartition(5)
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    model = quality.fit(docs, labels)
    train = [r for r in quality.sample_labelled(docs, labels, "quality", 1000).collect() if r.part]
    z = quality.fourier(np.array([quality.statistics(r.text) for r in train]), model.mean, model.scale, model.frequencies, model.phases)
    y = np.array([r.label for r in train])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) / quality.FEATURES * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)


def test_learned_words_and_stems():
    draw = random.Random(9)
    texts, y = [], []
    for i in range(300):
        w = words(draw, 60).split()
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            w.insert(draw.randrange(len(w)), "zorblax")
            w.insert(draw.randrange(len(w)), "qqrum" + draw.choice("abcdef") + draw.choice("abcdef"))
        texts.append(" ".join(w))
        y.append(float(bad))
    texts += [texts[1] + " copied"] * 60  # copies of a clean text under the wrong label teach nothing
    y += [1.0] * 60
    stems = toxicity.learn_stems(texts, y)
    assert "zorblax" in stems and "qqrum" in stems and len(stems) == 2
    assert toxicity.learn_words(texts, y, stems) == {} and all(0 < w <= toxicity.WORD for w in stems.values())
    assert outcomes("here is qqrumxy", stems=stems) == ["coded"]


def test_toxicity_on_held_out_rows(spark):
    texts, _, label = corpus(random.Random(10))
    docs = documents(spark, texts + AWKWARD)
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    rows = docs.select("doc_id", quality.score_column(docs, fitted, F.col("text")).alias("s")).collect()
    assert len(rows) == len(texts) + len(AWKWARD) and all(0 <= r.s <= 1 for r in rows)
    assert all((r.s >= 0.3) == bool(label[r.doc_id]) for r in rows if r.doc_id < len(texts))
    assert not any(r.s >= 0.3 for r in rows if r.doc_id >= len(texts))
    default = toxicity.fit(docs, labels.where("false"))
    assert default.score(["you are an idiot", "a fine day", None])[0] > 0.3 > default.score(["a fine day"])[0]
