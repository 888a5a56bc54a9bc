"""Preference formatting against a loop, and the pipeline's stages against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinetrail.llm import quality, toxicity
from kinetrail.llm.common import fold
from kinetrail.llm.preferences import format_preferences, self_pairs

from .fixtures import AWKWARD, documents, words
from .test_search_and_dedup import classes, sets_of

PAIRS = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string, id int"


def formatted(chosen, rejected):
    clean = lambda turns: [(r or "user", t or "") for r, t in turns or []]
    a, b = clean(chosen), clean(rejected)
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if rejected is None:
        p = len(a)
    show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def mask(turns):
        at, out = 0, []
        for r, t in turns:
            n, head = len(show([(r, t)])), len(f"<|{r}|>\n")
            if r == "assistant":
                out.append(f"{at + head}-{at + n}")
            at += n
        return ",".join(out)

    if rejected is None:
        return p, show(a), None, None, None, None
    return p, show(a[:p]), show(a[p:]), show(b[p:]), mask(a[p:]), mask(b[p:])


def test_pairs_equal_a_loop(spark):
    u, a, s = "user", "assistant", "system"
    rows = [
        ([(s, "be kind"), (u, "hi"), (a, "hello")], [(s, "be kind"), (u, "hi"), (a, "go away"), (u, "why"), (a, "because")]),
        ([(u, "x")], [(u, "x")]),
        ([(u, "x")], [(a, "y")]),
        ([], [(u, "x")]),
        ([(u, "q")], []),
        (None, []),
        ([(u, "q"), (a, "r")], None),
        (None, None),
        ([(None, None), (a, None)], [(u, ""), (a, "z" * 5000)]),
        ([(a, "é😀"), (a, "b")], [(a, "é😀"), (a, "c")]),
    ]
    df = spark.createDataFrame([(i, c, r, "clash", 1) for i, (c, r) in enumerate(rows)], PAIRS)
    got = {r.pair_id: tuple(r)[1:] for r in format_preferences(df).collect()}
    assert got == {i: formatted(c, r) for i, (c, r) in enumerate(rows)}


def test_pairs_of_plain_conversations(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "more"), (1, 3, "assistant", "two"), (1, 4, "user", "bye"), (2, 0, "user", "alone"), (3, 5, "assistant", "only"), (4, 0, None, None), (4, 0, None, None), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    got = {r.conv_id: r for r in format_preferences(self_pairs(df), "conv_id").collect()}
    assert got[1].prompt_turns == 3 and got[1].chosen.endswith("two<|end|>\n") and got[1].rejected.endswith("one<|end|>\n")
    assert got[1].chosen[slice(*map(int, got[1].chosen_mask.split("-")))] == "two<|end|>\n"
    assert got[2].chosen is None and got[2].prompt_turns == 1 and got[4].prompt_turns == 2
    assert got[3].rejected_mask == "14-22" and len(got) == 5
    assert format_preferences(self_pairs(df.where("false")), "conv_id").count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with known junk, insults and copies."""
    draw = random.Random(12)
    rows, labels, kinds = [], [], {}
    base = [words(draw, 80) for _ in range(160)]
    for i in range(320):
        kind = ["clean", "clean", "junk", "toxic", "copy"][i % 5]
        t = base[i % 160]
        if kind == "junk":
            t = " ".join(w + draw.choice(["###", "$$$", "&&&"]) for w in words(draw, 80).split())
        elif kind == "toxic":
            w = words(draw, 80).split()
            for _ in range(4):
                w.insert(draw.randrange(len(w)), draw.choice(["idiot", "moron", "scum"]))
            t = " ".join(w)
        elif kind == "copy":
            w = rows[i - 4][1].split()
            w[0] = "changed"
            t = " ".join(w)
        else:
            t = words(draw, 80)
        rows.append((i, t, "en", "s", len(t)))
        kinds[i] = kind
        if i % 2 or kind in ("junk", "toxic"):
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, kinds


def test_stages(spark, folder):
    d, rows, kinds = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_dedup", "packing"]
    kept = stages["quality"](spark, docs, d).cache()
    fitted = quality.fit(docs, labels)
    want = {r[0] for r in rows if fitted.score([r[1]])[0] >= 0.7}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    assert {i for i in want} == {i for i, k in kinds.items() if k != "junk"}
    fine = stages["toxicity"](spark, kept, d).cache()
    assert {r.doc_id for r in fine.collect()} == {i for i in want if kinds[i] != "toxic"}
    assert toxicity.fit(kept, labels).score([rows[3][1]])[0] >= 0.3
    alone = stages["near_dedup"](spark, fine, d)
    left = sorted(r.doc_id for r in fine.collect())
    group = classes(left, sets_of([rows[i][1] for i in left]), 80)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(set(group)) and alone.columns == docs.columns
    assert all(kinds[i] != "copy" for i in set(group))
    packed = stages["packing"](spark, alone, d).collect()
    assert {r.doc_id for r in packed} == set(group)


def test_run_equals_its_stages(spark, folder):
    d, _, kinds = folder
    got = {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()}
    assert got == {i for i, k in kinds.items() if k == "clean"}


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_of_awkward_tables(spark, tmp_path, labelled):
    draw = random.Random(31)
    texts = AWKWARD + [words(draw, 60) for _ in range(30)] + [words(draw, 30) + " idiot moron scum"] * 3 + ["### $$$ " * 40] * 12 + ["word of " * 30_000]
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = documents(spark, texts, ids=ids)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, int("###" not in (t or "")), int("idiot" in (t or ""))) for i, t in zip(ids, texts)] if labelled else []
    spark.createDataFrame([*rows, (None, 1, 1), (7, None, None)][: None if labelled else 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if not labelled:
        assert not found
        return
    left = {r.doc_id for r in found}
    bad = {i for i, t in zip(ids, texts) if "###" in (t or "") or "idiot" in (t or "")}
    assert left and not left & bad
    pieces = {}
    for r in found:
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert sum(pieces[i] for i in left if i not in (None, 1)) == sum({r.doc_id: r.doc_tokens for r in found if r.doc_id not in (None, 1)}.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
