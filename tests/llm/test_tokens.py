"""Token files, packing and the sentencepiece model against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinetrail.llm.common import tokenizer_path
from kinetrail.llm.encoding import PATTERN, library_encoder
from kinetrail.llm.packing import Limits, VectorPacker, pack_documents, pack_examples
from kinetrail.llm.sentencepiece_bpe import encode_decode, rank_tokenizer
from kinetrail.llm.token_files import Shard, read_token_files, write_token_files

from .fixtures import AWKWARD, documents

JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


MIXED = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r'sdtrevml,.!AbZ09_")), st.characters(exclude_categories=("Cs",))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_both_encoders_equal_their_libraries(text):
    t = test_both_encoders_equal_their_libraries.__dict__.setdefault("t", Tokenizer.from_file(JSON))
    t.encode_special_tokens = True
    want = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(library_encoder(JSON)([text])[0], "<u4").tolist() == want
    own = rank_tokenizer(RANKS)
    ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
    assert ids == want and own.decode(ids) == text.encode()


def test_awkward_texts_in_token_files(spark, library):
    ids = [5, 3, 3, None, 9, 1, 0, 12, 11, 10, 2**40, 7, 6, 4, -8]
    files = write_token_files(documents(spark, AWKWARD, ids=ids), JSON, shards=4)
    rows = sorted(zip(ids, AWKWARD), key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    coded = [(i, [*library(t), 0]) for i, t in rows]
    # rows of one id are ordered by the bytes of their ids
    coded = sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    for i, x in coded:
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x))
        at += len(x)
    got = sorted((tuple(r) for r in read_token_files(spark, files, with_ids=True).collect()), key=lambda r: r[1])
    assert got == want
    assert sum(files.lengths) == at and files.bases[0] == 0


def test_files_are_flat_and_mapped(spark, library):
    files = write_token_files(documents(spark, ["one two", "three"]), JSON, shards=1)
    shard = Shard(files.uri, 0)
    assert isinstance(shard.ids, np.memmap) and shard.ids.tolist() == [*library("one two"), 0, *library("three"), 0]
    assert shard.offsets.tolist() == [0, len(library("one two")) + 1, len(shard.ids)]


def test_shards_on_other_stores_are_read_in_ranges(spark, library, monkeypatch):
    files = write_token_files(documents(spark, ["one two", "three", None]), JSON, shards=1)
    import kinetrail.llm.token_files as tf
    from pyarrow import fs

    monkeypatch.setattr(tf, "arrow_fs", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.removeprefix("file://")))
    shard = Shard(files.uri, 0)
    assert not shard.mapped and [x.tolist() for x in shard.documents(0, 3)] == [[*library(t), 0] for t in ("one two", "three", "")]


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from kinetrail.llm.common import sliced

    texts = ["a" * 10, None, "b" * 100, "c" * 5, "d" * 5, "", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    runs = [b.column(1).to_pylist() for b in sliced(batch.slice(1), 1, 20, 3)]
    assert runs == [[None], ["b" * 100], ["c" * 5, "d" * 5, ""], ["e"]] and list(sliced(batch.slice(7), 1)) == []


def test_empty_tables(spark):
    none = documents(spark, ["x"]).where("false")
    assert read_token_files(spark, write_token_files(none, JSON)).count() == 0
    assert pack_documents(none, JSON).count() == 0
    assert encode_decode(none, RANKS).count() == 0


def check_packing(rows, ids_of, limit=1024):
    covered, sequences = {}, {}
    for r in rows:
        x = ids_of[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(covered) == set(ids_of)
    for parts, total in [*((covered[d], len(ids_of[d])) for d in ids_of), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert total is None or at == total
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes) <= limit
    assert all(n == limit or n & (n - 1) == 0 for n in sizes)  # no padding at all
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)


def test_packing_of_awkward_texts(spark, library):
    docs = documents(spark, AWKWARD)
    check_packing(pack_documents(docs, JSON).collect(), {i: [*library(t), 0] for i, t in enumerate(AWKWARD)})


def prompt_of(ids, library):
    """Tokens through the first that ends a sentence or line, unless that is all."""
    ends = [i for i, x in enumerate(ids) if any(c in library.text(x) for c in ".!?\n")]
    return ends[0] + 1 if ends and ends[0] + 1 < len(ids) else 0


def test_document_packing_keeps_all_three_limits(spark):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True

    def ids_of(text):
        return [*t.encode(text, add_special_tokens=False).ids, 0]

    ids_of.text = lambda i: t.decode([i], skip_special_tokens=False)
    draw = random.Random(17)
    texts = ["a"] * 400 + ["b c d " * 2500, "One opening. " + "then much more text " * 700]
    texts += [" ".join(draw.choice(["Go.", "a", "long", "tale", "told", "twice"]) for _ in range(draw.randint(3, 900))) for _ in range(150)]
    draw.shuffle(texts)
    limits = Limits(tokens=512, segments=6, loss_tokens=509, pool=32)
    rows = pack_documents(documents(spark, texts).coalesce(2), JSON, limits).collect()
    ids = {i: ids_of(x) for i, x in enumerate(texts)}
    check_packing(rows, ids, 512)
    held = {}
    for r in rows:
        prompt = prompt_of(ids[r.doc_id][:-1], ids_of)
        assert r.loss_tokens == r.length - min(r.length, max(1, prompt - r.start))
        n, loss = held.get(r.sequence_id, (0, 0))
        held[r.sequence_id] = n + 1, loss + r.loss_tokens
    assert max(n for n, _ in held.values()) == 6 and max(loss for _, loss in held.values()) == 509
    full = sum(sum(r.length for r in rows if r.sequence_id == s) == 512 for s in held)
    assert full >= 0.8 * sum(map(len, ids.values())) / 512


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 200), st.integers(0, 40)), max_size=40), st.sampled_from([16, 64, 128]), st.integers(1, 6), st.integers(1, 128), st.sampled_from([1, 4, 64]))
def test_any_limits_hold(examples, tokens, segments, loss_tokens, pool):
    packer, out = VectorPacker(Limits(tokens, segments, loss_tokens, pool), cut=True, unseen=1), []
    for i, (n, prompt) in enumerate(examples):
        out += packer.add(i, n, max(0, n - prompt))
    out += packer.finish()
    covered, held = {}, {}
    for key, start, n, sequence, offset in out:
        covered.setdefault(key, []).append((start, n))
        loss = n - min(n, max(1, examples[key][1] - start))
        held.setdefault(sequence, []).append((offset, n, loss))
    for i, (n, _) in enumerate(examples):
        assert [x for start, m in sorted(covered[i]) for x in range(start, start + m)] == list(range(n))
    for pieces in held.values():
        size = sum(n for _, n, _ in pieces)
        assert [x for o, n, _ in sorted(pieces) for x in range(o, o + n)] == list(range(size))
        assert size <= tokens and size & (size - 1) == 0 and len(pieces) <= segments and sum(x for _, _, x in pieces) <= loss_tokens


def test_vector_packing_of_whole_examples(spark):
    draw = random.Random(3)
    rows = [(i, n := draw.randint(1, 600), draw.randint(0, n)) for i in range(400)]
    limits = Limits(tokens=1024, segments=6, loss_tokens=500, pool=64)
    rows = [(i, n, min(l, 500)) for i, n, l in rows]
    out = pack_examples(spark.createDataFrame(rows, "example_id long, tokens int, loss_tokens int").coalesce(1), limits).collect()
    assert sorted(r.example_id for r in out) == list(range(400))
    loss, size, count = {}, {}, {}
    for r in out:
        assert r.start == 0 and r.length == rows[r.example_id][1]
        for d, v in ((loss, rows[r.example_id][2]), (size, r.length), (count, 1)):
            d[r.sequence_id] = d.get(r.sequence_id, 0) + v
    assert max(loss.values()) <= 500 and max(size.values()) <= 1024 and max(count.values()) <= 6
    need = max(sum(r[1] for r in rows) / 1024, sum(r[2] for r in rows) / 500, 400 / 6)
    assert len(size) <= 1.35 * need
    with pytest.raises(ValueError):
        list(VectorPacker(limits, cut=False).add(0, 2000, 0))


def test_ranks_against_tiktoken(spark, ranked):
    out = {r.doc_id: r for r in encode_decode(documents(spark, AWKWARD), RANKS, with_ids=True).collect()}
    for i, t in enumerate(AWKWARD):
        ids = ranked(t or "")
        r = out[i]
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (t or "").encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_another_rank_file():
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    own = rank_tokenizer(path)
    for t in AWKWARD:
        assert np.frombuffer(own.encode([t or ""])[0], "<u4").tolist() == want(t or "")


def test_other_tokenizer_files_go_through_whole():
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in ("Hello  World", "", "it's 5"):
        assert np.frombuffer(library_encoder(path)([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
