"""Shared plumbing: scratch space every executor sees, hash folds, tokenizer paths."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a batch, so many rows or bytes of text are worked on at once.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, local sessions (tests) get a temporary folder; on a
    cluster such a folder would be another one on each machine, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="kinetrail-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def sliced(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS, extra: int = 0) -> Iterator[pa.RecordBatch]:
    """Runs of at most *rows* rows, cut where the values of *column* (and *extra* bytes a row) pass *most* bytes.

    A value over *most* is a run of its own, so that what is made of a run
    stays far below the 2 GiB that an Arrow column may hold.
    """
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8") + extra
    total = np.cumsum(sizes)
    a = 0
    while a < batch.num_rows:
        before = total[a - 1] if a else 0
        b = min(a + rows, max(a + 1, int(np.searchsorted(total, before + most, "right"))), batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write *df* to shared Parquet and read it back: the lineage ends at files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dispose(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect garbage: Spark deletes the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def arrow_fs(uri: str):
    """``(filesystem, path)`` of a URI or a plain path, for use inside a task."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        path = urlparse(uri).path
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file written under a temporary name and moved into place by :meth:`close`, so that a repeated task does no harm."""

    def __init__(self, uri: str):
        self.filesystem, self.path = arrow_fs(uri)
        self.filesystem.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.filesystem.open_output_stream(self.temp)
        self.write = self.stream.write

    def close(self) -> None:
        self.stream.close()
        try:
            self.filesystem.move(self.temp, self.path)
        except OSError:  # stores whose rename does not replace
            self.filesystem.delete_file(self.path)
            self.filesystem.move(self.temp, self.path)


def write_atomic(uri: str, chunks) -> None:
    out = AtomicFile(uri)
    for chunk in chunks:
        out.write(chunk)
    out.close()


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id written as text, mod k; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file (the folder can be set by ``KINETRAIL_TOKENIZERS``)."""
    root = os.environ.get("KINETRAIL_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def within_budget(rows, size, chars: int):
    """Rows in the order they come while they fit what is left of *chars*; one that does not fit is passed over."""
    left = chars
    for r in rows:
        if (n := size(r)) <= left:
            left -= n
            yield r
