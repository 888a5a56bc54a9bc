"""KD-tree search and near-duplicate classes against brute force."""

import math
import random

import numpy as np
import pytest

from kinetrail.llm.kd_search import Best, Tree, build_index, search, top_k
from kinetrail.llm.near_dedup import BUCKETS, components, drop_near_duplicates, estimate, near_duplicates, registers, shingle_set

from .fixtures import AWKWARD, documents, words


def brute(rows, k, of=lambda i: True):
    good = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in good:
        if of(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("leaf,shard", [(4, 64), (256, 65536)])
def test_top_k_equals_brute_force(spark, leaf, shard):
    draw = np.random.default_rng(1)
    rows = [(int(i), draw.normal(0, 1, 8).tolist()) for i in draw.permutation(400)]
    same = draw.normal(0, 1, 8).tolist()
    rows += [(1000 + i, same) for i in range(150)]  # a hot vector
    rows += [(2000, None), (2001, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, same), (2010, [1.0, 2.0]), (2020, [3.0, 4.0]), (2025, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    shards = build_index(df, shard_rows=shard, leaf=leaf)
    got = {tuple(r) for r in top_k(df.where("vec_id % 5 = 0"), shards, 5).collect()}
    assert got == brute(rows, 5, lambda i: i % 5 == 0)


def test_huge_components_stay_exact():
    v = np.floor(256.0 * np.array([[1e14, 1.0], [1e14, 2.0], [-1e14, 3.0], [1e14, 2.0]]))
    tree, best = Tree.build(v, np.arange(4), leaf=1), Best(3)
    search(tree, v[:1], [0], [best])
    want = sorted((-sum(int(a) * int(b) for a, b in zip(v[0], w)), i) for i, w in enumerate(v) if i)[:3]
    assert list(zip([-s for s in best.scores], best.ids)) == want


def test_huge_components_through_spark(spark):
    rows = [(0, [1e306, 1.0]), (1, [1e308, 2.0]), (2, [-1e307, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df.where("vec_id < 1"), build_index(df), 5).collect()}
    assert got == {(0, 1): (1, 2**63 - 1), (0, 2): (3, 2**63 - 1), (0, 3): (2, -(2**63))}


def test_shards_that_cannot_help_are_not_read(spark):
    near = [(i, [10.0 + i % 3, 1.0]) for i in range(40)]
    far = [(100 + i, [-50.0, -1.0 - i]) for i in range(40)]
    df = spark.createDataFrame(near + far, "vec_id long, embedding array<double>").coalesce(1)
    shards = build_index(df, shard_rows=40)
    assert len(shards) == 2
    only = [s if s.least == 0 else type(s)("/no/such/file", s.d, s.lo, s.hi, s.least) for s in shards]
    queries = df.where("vec_id = 0")
    assert top_k(queries, only, 5).collect() == top_k(queries, shards, 5).collect()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, build_index(none)).count() == 0


def sets_of(texts):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for s in "\t\n\x0b\x0c\r":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def classes(ids, sets, percent):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return [root(i) for i in ids]


def mutated(draw, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[draw.randrange(len(w))] = "".join(draw.choice("xyz") for _ in range(6))
    return " ".join(w)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    draw = random.Random(percent)
    texts = list(AWKWARD)
    for n in (5, 6, 7, 12, 30, 120, 400):
        base = words(draw, n)
        texts += [base, base.upper(), base.replace(" ", "\t\n"), base + " " + words(draw, 1)]
        texts += [mutated(draw, base, k) for k in range(1, 6) for _ in range(3)]
    passage = words(draw, 60)
    texts += [words(draw, 40) + " " + passage for _ in range(30)]  # alike, but not enough
    draw.shuffle(texts)
    ids = draw.sample(range(10_000), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, texts, ids=ids), percent).collect()}
    sets = sets_of(texts)
    assert got == {i: (len(s), c, i == c) for i, s, c in zip(ids, sets, classes(ids, sets, percent))}


def test_a_hot_group_whose_links_run_through_one_text(spark):
    draw = random.Random(2)
    base = words(draw, 150)
    texts = [mutated(draw, base, draw.choice([1, 2, 2, 3, 6, 9])) for _ in range(120)] + [base] * 40
    ids = list(range(len(texts)))
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts, ids=ids)).collect()}
    assert got == dict(zip(ids, classes(ids, sets_of(texts), 85)))


@pytest.mark.parametrize("candidates", [0, 1000])
def test_blocks_of_a_large_bucket_lose_nothing(spark, monkeypatch, candidates):
    from kinetrail.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CANDIDATES", candidates)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(near_dedup, "HOT_PAIRS", 4)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 3)
    draw = random.Random(5)
    base = words(draw, 90)
    texts = [mutated(draw, base, draw.choice([1, 2, 4, 7])) for _ in range(80)]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert got == dict(enumerate(classes(list(range(80)), sets_of(texts), 85)))


def test_dedup_of_awkward_tables(spark):
    docs = documents(spark, ["one two three four five six"] * 3 + [None, "", "other words in this text here"], ids=[4, 2, 9, 5, 6, None])
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 2), (False, 5), (False, 6), (True, 0)]
    assert near_duplicates(docs.where("false")).count() == 0
    assert drop_near_duplicates(docs.where("false")).count() == 0
    twice = near_duplicates(documents(spark, ["a b c d e f"] * 2, ids=[3, 3])).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in twice] == [(3, 3, True)] * 2


def test_sketches_estimate_similarity():
    draw = random.Random(8)
    for share in (0.3, 0.6, 0.9):
        common = [words(draw, 1, "abcdefghij") for _ in range(3000)]
        got = []
        for _ in range(6):
            draw.shuffle(common)
            n = int(len(common) * 2 * share / (1 + share))
            a, b = (shingle_set(" ".join(common[:n] + [words(draw, 1) for _ in range(3000 - n)])) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same = np.array([(registers(a) == registers(b)).mean()])
            got.append(estimate(same, np.array([len(a)]))[0] - true)
        assert abs(np.mean(got)) < 4 * math.sqrt(0.25 / BUCKETS / 6)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 140)) and got[200] == 199
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
