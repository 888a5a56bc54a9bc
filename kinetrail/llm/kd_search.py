"""Exact top-k by integer inner product: a KD-tree per shard, best-first search.

Build: each scan partition cuts its vectors into shards of bounded size, and
each shard becomes a tree of median splits whose nodes keep a tight bounding
box and their smallest id; trees are written to shared storage, one file each,
and their root boxes (a row a shard) go to the searching tasks.
Search: tasks stream blocks of queries past the shards, those of the highest
root bounds first, one tree in memory at a time; a shard whose root box can
improve no query of the block is not read.  In a tree, nodes are taken from a heap by their box's upper bound on
the score; a node is skipped when its bound is under the kth score found so
far, or equal to it with no smaller id.  The kth score is carried from node to
node and from shard to shard.  There is no shuffle, and a row only for results.

A component x becomes floor(256 x), held at the largest double.  Defined cases: vectors that are null,
empty, or hold null or non-finite components, and rows without an id take no
part; only vectors of one length are compared; ties go to the smaller id;
repeated rows count each, but no row of the query's own id; scores outside
64 bits are held at its ends; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fs, scratch, write_atomic

LEAF = 256
SHARD_ROWS = 65_536
BLOCK = 2048
_EXACT = float(2**53)


@dataclass
class Tree:
    """Arrays of a KD-tree; ``left`` is -1 for a leaf, whose rows are start:end."""

    vectors: np.ndarray
    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    min_id: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        nodes: list[list] = []

        def grow(a: int, b: int) -> int:
            rows = vectors[order[a:b]]
            lo, hi, me = rows.min(0), rows.max(0), len(nodes)
            nodes.append([lo, hi, a, b, -1, -1, ids[order[a:b]].min()])
            spread = hi - lo
            axis = int(np.argmax(spread))
            if b - a > leaf and spread[axis] > 0:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, axis], mid, kind="introselect")]
                nodes[me][4], nodes[me][5] = grow(a, a + mid), grow(a + mid, b)
            return me

        grow(0, len(order))
        lo, hi, start, end, left, right, least = map(np.array, zip(*nodes))
        return cls(vectors[order], ids[order], lo, hi, start, end, left, right, least)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            return cls(**{k: z[k] for k in z.files})


class Best:
    """The k best (score, id) of one query so far: higher scores first, then smaller ids."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, [], []

    def hopeless(self, bound, least_id: int) -> bool:
        return len(self.ids) == self.k and (bound < self.scores[-1] or bound == self.scores[-1] and least_id > self.ids[-1])

    def take(self, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        good = ids != own
        if len(self.ids) == self.k:
            good &= (scores > self.scores[-1]) | ((scores == self.scores[-1]) & (ids < self.ids[-1]))
        if not good.any():
            return
        scores, ids = scores[good], ids[good]
        if len(ids) > 4 * self.k:  # ties at the cut stay in
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        merged = sorted(zip([-s for s in self.scores + scores.tolist()], self.ids + ids.tolist()))[: self.k]
        self.scores, self.ids = [-s for s, _ in merged], [i for _, i in merged]


def search(tree: Tree, queries: np.ndarray, own: list[int], best: list[Best]) -> None:
    """Improve each query's *best* by this tree."""
    top = float(np.abs(tree.vectors).max(initial=0)), float(np.abs(queries).max(initial=0))
    kind = "f8" if top[0] * top[1] * tree.vectors.shape[1] < _EXACT else object  # whole numbers, exact either way
    whole = (lambda a: a.astype("f8")) if kind == "f8" else (lambda a: np.vectorize(int, otypes=[object])(a))
    vectors, lo, hi, q = whole(tree.vectors), whole(tree.lo), whole(tree.hi), whole(queries)
    bounds = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    left, right, start, end, least = (x.tolist() for x in (tree.left, tree.right, tree.start, tree.end, tree.min_id))
    for i, mine in enumerate(best):
        bound, heap = bounds[i].tolist(), [(-bounds[i, 0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if mine.hopeless(-b, least[node]):
                if len(mine.ids) == mine.k and -b < mine.scores[-1]:
                    break
                continue
            if left[node] < 0:
                rows = slice(start[node], end[node])
                mine.take(vectors[rows] @ q[i], tree.ids[rows], own[i])
            else:
                for child in (left[node], right[node]):
                    if not mine.hopeless(bound[child], least[child]):
                        heapq.heappush(heap, (-bound[child], child))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(256 x)) of the batch's vectors, by vector length."""
    vectors = batch.column(1)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
    with np.errstate(over="ignore"):  # 256 x beyond the doubles is held at the largest
        flat = np.clip(np.floor(256.0 * flat), -np.finfo("f8").max, np.finfo("f8").max)
    offsets = vectors.offsets.to_numpy()
    offsets, sizes, ids = offsets[:-1] - offsets[0], np.diff(offsets), batch.column(0).to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], flat[offsets[rows][:, None] + np.arange(d)]


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & good).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))


@dataclass(frozen=True)
class Shard:
    """A tree's file, its vectors' length, root box and smallest id."""

    file: str
    d: int
    lo: np.ndarray
    hi: np.ndarray
    least: int

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's scores; infinite where doubles would not be exact."""
        top = max(float(np.abs(self.lo).max()), float(np.abs(self.hi).max())), float(np.abs(queries).max(initial=0))
        if not top[0] * top[1] * self.d < _EXACT:
            return np.full(len(queries), np.inf)
        return np.maximum(queries, 0) @ self.hi + np.minimum(queries, 0) @ self.lo


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF, uri: str | None = None) -> list[Shard]:
    """Write the trees; what is known of each shard comes back, a row for up to *shard_rows* vectors."""
    uri = uri or scratch(vectors.sparkSession, "kd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, {}

        def write(d: int) -> pa.RecordBatch:
            nonlocal n
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(d)))
            small = next((k for k in ("i2", "i4") if np.abs(rows).max() <= np.iinfo(k).max), "f8")
            name = f"{uri}/tree-{part:06d}-{n:04d}.npz"
            write_atomic(name, [Tree.build(rows.astype(small) if small != "i2" else rows.astype("i4"), ids, leaf).dumps()])
            n += 1
            box = [pa.array([x.astype("f8").tolist()], pa.list_(pa.float64())) for x in (rows.min(0), rows.max(0))]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([d], pa.int32()), *box, pa.array([int(ids.min())], pa.int64())], ["file", "d", "lo", "hi", "least"])

        for batch in batches:
            for ids, rows in _by_length(batch):
                d = rows.shape[1]
                while len(ids):
                    have = sum(len(x) for x, _ in held.setdefault(d, []))
                    room = shard_rows - have
                    held[d].append((ids[:room], rows[:room]))
                    ids, rows = ids[room:], rows[room:]
                    if len(held[d][-1][0]) == room:
                        yield write(d)
        for d in list(held):
            if held[d]:
                yield write(d)

    found = _usable(vectors, id_col, vector_col).mapInArrow(run, "file string, d int, lo array<double>, hi array<double>, least long")
    return [Shard(r.file, r.d, np.array(r.lo), np.array(r.hi), r.least) for r in found.collect()]


def top_k(queries: DataFrame, shards: list[Shard], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best."""

    def answer(d: int, ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        best, own = [Best(k) for _ in ids], ids.tolist()
        bounds = [(shard, shard.bounds(rows)) for shard in shards if shard.d == d]
        for shard, bound in sorted(bounds, key=lambda x: -float(x[1].max())):
            if all(b.hopeless(x, shard.least) for b, x in zip(best, bound.tolist())):
                continue
            filesystem, path = arrow_fs(shard.file)
            with filesystem.open_input_stream(path) as f:
                search(Tree.loads(f.read()), rows, own, best)
        hold = lambda s: max(-(2**63), min(2**63 - 1, int(s)))
        out = [(q, r + 1, i, hold(s)) for q, b in zip(own, best) for r, (s, i) in enumerate(zip(b.scores, b.ids))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["query_id", "rank", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for ids, rows in _by_length(batch):
                d = rows.shape[1]
                held.setdefault(d, []).append((ids, rows))
                if sum(len(x) for x, _ in held[d]) >= BLOCK:
                    yield from answer(d, *(np.concatenate(x) for x in zip(*held.pop(d))))
        for d, x in held.items():
            yield from answer(d, *(np.concatenate(y) for y in zip(*x)))

    return _usable(queries, id_col, vector_col).mapInArrow(run, "query_id long, rank int, vec_id long, score long")
