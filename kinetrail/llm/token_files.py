"""Token-id output: flat unsigned-integer files with 64-bit document offsets.

``write_token_files`` encodes each text in the map stage, deals the id arrays
to shards by ranges of the id column (bounds from quantiles of that column
alone, so texts are read once), and writes each shard sorted as two files:

* ``shard-N.bin``: the ids, little-endian uint16 or uint32, nothing else;
* ``shard-N.idx``: a 32-byte header, ``n + 1`` uint64 offsets into the shard,
  ``n`` int64 document ids, ``n`` bytes that flag null ids.

There are as many shards as shuffle partitions, and more where a shard would
have over ``SHARD_BYTES`` of input.  A document's place in the whole output is its shard's base plus its offset;
the bases are the prefix sum of the shards' lengths, one number a shard.
Shards are written under temporary names and moved into place, so a repeated
or lost task leaves the same files.

Defined cases: null text counts as empty and gives the end id alone; null ids
come first; rows that repeat an id lie in one shard, ordered by their ids'
bytes; an empty table gives no shards and no rows; very long texts are encoded
whole, in slices of bounded bytes (a text of its own if longer); other columns
are ignored.
"""

from __future__ import annotations

import gc
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, arrow_fs, input_bytes, scratch, shuffle_partitions, sliced, write_atomic
from .encoding import library_encoder, vocabulary_size

_HEADER = "<8sIIQQ"
_MAGIC = b"KTOKENS1"
_RUN_IDS = np.uint64(4 << 20)
#: Bytes of input that a shard should have at most.
SHARD_BYTES = 256 << 20


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are; ``lengths[i]`` is the number of ids in shard i."""

    uri: str
    lengths: tuple[int, ...]

    @property
    def bases(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.array(self.lengths, "i8"))])[:-1]


def encode_documents(docs: DataFrame, tokenizer: str, bounds: list[int], end_id: int, wide: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, doc_id, ids) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encode, kind = library_encoder(tokenizer), "<u4" if wide else "<u2"
        end = np.array([end_id], kind).tobytes()
        cuts = np.array(bounds, "i8")
        for whole in batches:
            for batch in sliced(whole, 1):
                ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in encode([t or "" for t in batch.column(1).to_pylist()])]
                key = batch.column(0)
                shard = np.searchsorted(cuts, key.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left").astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(shard), key, pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "shard int, doc_id long, ids binary")


def write_token_files(docs: DataFrame, tokenizer: str, uri: str | None = None, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    spark = docs.sparkSession
    uri = uri or scratch(spark, "tokens")
    shards = shards or max(shuffle_partitions(spark), -(-input_bytes(docs) // SHARD_BYTES))
    quantiles = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / shards for i in range(1, shards)] or [0.5], 20 * shards).alias("q")).first()
    bounds = sorted(set(quantiles.q or [])) if shards > 1 else []
    wide = vocabulary_size(tokenizer) > 1 << 16 or end_id >= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([writer.shard], pa.int32()), pa.array([writer.close()], pa.int64())], ["shard", "n_tokens"])

        for batch in batches:
            for shard, key, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if writer is None or shard != writer.shard:
                    if writer is not None:
                        yield done()
                    writer = ShardWriter(uri, shard, 4 if wide else 2)
                writer.add(key, x)
        if writer is not None:
            yield done()

    encoded = encode_documents(docs, tokenizer, bounds, end_id, wide, id_col, text_col)
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    found = {r.shard: r.n_tokens for r in dealt.mapInArrow(run, "shard int, n_tokens long").collect()}  # a number a shard
    return TokenFiles(uri, tuple(found.get(i, 0) for i in range(len(bounds) + 1)) if found else ())


class ShardWriter:
    """Streams a shard's ids to its file and keeps only lengths and document ids."""

    def __init__(self, uri: str, shard: int, width: int):
        self.uri, self.shard, self.width = f"{uri}/shard-{shard:06d}", shard, width
        self.data, self.lengths, self.keys, self.nulls = AtomicFile(f"{self.uri}.bin"), array("q"), array("q"), bytearray()

    def add(self, key: int | None, ids: bytes) -> None:
        self.data.write(ids)
        self.lengths.append(len(ids) // self.width)
        self.keys.append(key or 0)
        self.nulls.append(key is None)

    def close(self) -> int:
        """Both files in place; the number of ids."""
        self.data.close()
        n, offsets = len(self.keys), np.concatenate([[0], np.cumsum(np.array(self.lengths, "i8"))]).astype("<u8")
        head = struct.pack(_HEADER, _MAGIC, self.width, 0, n, int(offsets[-1]))
        write_atomic(f"{self.uri}.idx", [head, offsets.tobytes(), np.array(self.keys, "<i8").tobytes(), bytes(self.nulls)])
        return int(offsets[-1])


class Shard:
    """A shard's ids and offsets: memory-mapped where the store is a local or mounted one, else read in ranges."""

    def __init__(self, uri: str, shard: int):
        self._filesystem, path = arrow_fs(f"{uri}/shard-{shard:06d}")
        self._data = f"{path}.bin"
        self.mapped = self._filesystem.type_name == "local"
        if self.mapped:
            raw = np.memmap(f"{path}.idx", "u1", "r")
        else:
            with self._filesystem.open_input_stream(f"{path}.idx") as f:
                raw = np.frombuffer(f.read(), "u1")
        magic, self.width, _, n, self.total = struct.unpack_from(_HEADER, raw[:32].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"not a token index: {uri}, shard {shard}")
        at = struct.calcsize(_HEADER)
        self.offsets = raw[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.doc_ids = raw[at : at + 8 * n].view("<i8")
        self.null_ids = raw[at + 8 * n : at + 9 * n].view("?")
        self.ids = np.memmap(self._data, f"<u{self.width}", "r") if self.mapped and self.total else np.empty(0, f"<u{self.width}")

    def documents(self, a: int, b: int) -> list[np.ndarray]:
        """The ids of documents a to b."""
        bounds = self.offsets[a : b + 1].astype("i8")
        if self.mapped:
            ids = self.ids[bounds[0] : bounds[-1]]
        else:
            with self._filesystem.open_input_file(self._data) as f:
                ids = np.frombuffer(f.read_at(int(bounds[-1] - bounds[0]) * self.width, int(bounds[0]) * self.width), f"<u{self.width}")
        return [ids[x:y] for x, y in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0])]


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as uint32) and, if asked for, the ids; one task a shard."""
    bases, uri = files.bases, files.uri
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if not files.lengths[k]:
                    continue
                shard = Shard(uri, k)
                n = len(shard.doc_ids)
                i = 0
                while i < n:  # runs of documents of bounded size
                    j = min(n, i + 4096, max(i + 1, int(np.searchsorted(shard.offsets, shard.offsets[i] + _RUN_IDS, "right")) - 1))
                    found, offsets = shard.documents(i, j), shard.offsets[i : j + 1].astype("i8")
                    cols = [
                        pa.array(shard.doc_ids[i:j].copy(), mask=shard.null_ids[i:j].copy()),
                        pa.array(offsets[:-1] + bases[k]),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(x.astype("<u4")) for x in found], pa.int64()),
                    ]
                    if with_ids:
                        cols.append(pa.array([x.astype("i4") for x in found], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    i = j

    n = len(files.lengths)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)
