"""Byte-level BPE through a sentencepiece model serialised from a rank file.

No training: each ranked byte string becomes a piece spelt in the byte
alphabet, with minus its rank as score, so that the best-scoring merge is the
lowest-ranked one; normalisation is the identity.  A pre-token that is itself
ranked is one id (as rank encoders have it); any other goes through
sentencepiece.  Decoding maps ids to pieces and pieces back to bytes.

Defined cases: null text is empty and gives no ids; empty ids decode to
nothing; unknown ids raise; rows that repeat an id or a text give a row each;
nothing is ordered, so there are no ties; very long texts are encoded whole, in
slices of bounded bytes (a text of its own if longer); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .encoding import PreTokenEncoder, as_symbols, byte_alphabet

_BPE, _NORMAL, _UNKNOWN = 2, 1, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """A protocol-buffer field: int as varint, float as fixed 32 bits, else length-delimited."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """(model bytes, rank of each model id). The model wants an unknown piece; it takes the last id."""
    alphabet = byte_alphabet()
    order = sorted(ranks, key=ranks.__getitem__)
    pieces = [_field(1, _field(1, "".join(alphabet[b] for b in piece)) + _field(2, -float(ranks[piece])) + _field(3, _NORMAL)) for piece in order]
    unknown = _field(1, _field(1, "<unk>") + _field(2, -1e9) + _field(3, _UNKNOWN))
    n = len(order)
    trainer = _field(3, _BPE) + _field(4, n + 1) + _field(40, n) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normal = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normal), np.array([ranks[p] for p in order], "<u4")


class RankTokenizer:
    """``encode(texts) -> uint32 ids as bytes``, ``decode(ids) -> bytes``."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.ranks = read_ranks(path)
        model, self.of_model = serialise_model(self.ranks)
        self.model = SentencePieceProcessor(model_proto=model)
        bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.pieces = {}
        for i, rank in enumerate(self.of_model.tolist()):
            self.pieces[rank] = bytes(bytes_of[c] for c in self.model.id_to_piece(i))
        self.encode = PreTokenEncoder(self._encode_many)

    def _encode_many(self, pre_tokens: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pre_tokens]
        out: list = [self.ranks.get(x) for x in raw]
        rest = [i for i, x in enumerate(out) if x is None]
        coded = self.model.encode([as_symbols(pre_tokens[i]) for i in rest], num_threads=1)
        for i, ids in zip(rest, coded):
            out[i] = self.of_model[ids].tobytes()
        return [struct.pack("<I", x) if type(x) is int else x for x in out]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(2)
def rank_tokenizer(path: str) -> RankTokenizer:
    return RankTokenizer(path)


def encode_decode(docs: DataFrame, ranks_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row and, if asked for, ids and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        tokenizer = rank_tokenizer(ranks_path)
        decimals: dict[int, str] = {r: str(r) for r in tokenizer.pieces}
        for whole in batches:
            for batch in sliced(whole, 1):
                ids = [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])]
                decoded = list(map(tokenizer.decode, ids))
                cols = [
                    batch.column(0),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(decimals.__getitem__, x)).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ]
                if with_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
