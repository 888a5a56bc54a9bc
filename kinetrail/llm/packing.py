"""Vector bin packing of token sequences under several limits at once.

Each example is a vector (tokens, segments, loss-bearing tokens); a sequence
is a bin with a limit on each.  Examples of a partition are packed as they
stream by: a pool of waiting pieces feeds one open sequence at a time, which
takes the piece whose demand has the largest dot product with the room left
(both as shares of the limits), among those that fit.  Where pieces may be
cut, the last piece of a sequence is a front cut to fill it, and an example of
a sequence's length or more fills sequences, beside waiting pieces if need be.
A sequence that the limits on segments or loss keep from being full is cut
back to a power of two, which needs no padding.

Of a document, the opening sentence is the prompt and bears no loss, nor does
a piece's first token, which has nothing before it in its segment.  With a
loss limit of 1022 of 1024, a full sequence holds an opening or two pieces.

The pool (``Limits.pool`` pieces, of documents only the ids still waiting) and
the newest eight pieces of a length class that a choice looks at are
heuristics: other numbers pack closer or looser, but every limit holds and
every token is placed with any.  No shuffle: partitions pack alone, and
sequence ids are (partition << 40) + running number, unique without a global
count.

Defined cases: null text is empty (the end id alone); an empty table gives no
pieces; rows that repeat an id or a text are packed each; ties go to the
newest piece; very long texts are cut, and texts are encoded in slices of
bounded bytes; an uncut example over a limit raises; other columns are ignored.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .encoding import CACHE, library_encoder

_NEWEST = 8


@dataclass(frozen=True)
class Limits:
    """Of a sequence. ``pool``: pieces that wait before sequences are closed, a heuristic that also bounds memory."""

    tokens: int = 1024
    segments: int = 16
    loss_tokens: int = 1022
    pool: int = 4096


class VectorPacker:
    """Pieces ``(key, start, length, loss)`` in, ``(key, start, length, sequence, offset)`` out.

    ``loss`` counts the loss-bearing tokens at a piece's end (a masked prompt
    comes first), so a cut leaves the earlier part with the tokens before;
    *unseen* tokens at the start of any piece bear none.
    """

    def __init__(self, limits: Limits, cut: bool = True, unseen: int = 0):
        self.limits, self.cut, self.unseen = limits, cut, unseen
        self.classes: list[list[tuple]] = [[] for _ in range(limits.tokens.bit_length() + 1)]
        self.waiting, self.sequence = 0, 0

    def add(self, key, length: int, loss: int) -> Iterator[tuple]:
        lim = self.limits
        loss = max(0, min(loss, length - self.unseen))
        if not self.cut and (length > lim.tokens or loss > lim.loss_tokens):
            raise ValueError(f"an example of {length} tokens, {loss} with loss, is over the limits of a sequence")
        rest = (key, 0, length, loss) if length else None
        while rest and rest[2] >= lim.tokens and self.cut:
            rest = yield from self._close(rest)
        if rest:
            self._put(rest)
        while self.waiting > lim.pool:
            yield from self._close()

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._close()

    def _split(self, piece: tuple, part: int) -> tuple[tuple, tuple | None]:
        """A piece's first *part* tokens, and the rest."""
        key, start, n, loss = piece
        if part == n:
            return piece, None
        front = self._loss(piece, part)
        return (key, start, part, front), (key, start + part, n - part, max(0, min(loss - front, n - part - self.unseen)))

    @staticmethod
    def _loss(piece: tuple, part: int) -> int:
        """Loss-bearing tokens among a piece's first *part* tokens."""
        return max(0, part - (piece[2] - piece[3]))

    def _put(self, piece: tuple) -> None:
        self.classes[piece[2].bit_length()].append(piece)
        self.waiting += 1

    def _take(self, c: int, i: int) -> tuple:
        pieces = self.classes[c]
        pieces[i], pieces[-1] = pieces[-1], pieces[i]
        self.waiting -= 1
        return pieces.pop()

    def _best(self, room: tuple[int, int, int]) -> tuple | None:
        """The waiting piece of the largest dot product that fits: the newest few of each length class are looked at."""
        lim, best, top = self.limits, None, -1.0
        w = room[0] / lim.tokens**2, room[1] / lim.segments**2, room[2] / lim.loss_tokens**2
        for c in range(room[0].bit_length(), -1, -1):
            pieces = self.classes[c]
            for i in range(len(pieces) - 1, max(-1, len(pieces) - 1 - _NEWEST), -1):
                _, _, n, loss = pieces[i]
                if n <= room[0] and loss <= room[2] and (score := n * w[0] + w[1] + loss * w[2]) > top:
                    best, top = (c, i), score
            if best and c < room[0].bit_length():
                break  # shorter classes score less, but for masked pieces
        if best is None and not self.cut:  # whole classes before a sequence is closed with room to spare
            best = next(((c, i) for c in range(room[0].bit_length(), -1, -1) for i, p in enumerate(self.classes[c]) if p[2] <= room[0] and p[3] <= room[2]), None)
        return None if best is None else self._take(*best)

    def _filler(self, room: tuple[int, int, int]) -> tuple | None:
        """A waiting piece whose front fills the room, the shortest classes first."""
        for c in range(room[0].bit_length(), len(self.classes)):
            pieces = self.classes[c]
            for i in range(len(pieces) - 1, max(-1, len(pieces) - 1 - _NEWEST), -1):
                if pieces[i][2] >= room[0] and self._loss(pieces[i], room[0]) <= room[2]:
                    front, rest = self._split(self._take(c, i), room[0])
                    if rest:
                        self._put(rest)
                    return front
        return None

    def _close(self, lead: tuple | None = None) -> Iterator[tuple]:
        """Fill one sequence and give its pieces; with a long *lead*, up to its front. What is left of the lead comes back."""
        lim = self.limits
        taken, room = [], (lim.tokens, lim.segments, lim.loss_tokens)
        while room[0] and room[1]:
            if lead:
                if lead[2] >= room[0] and self._loss(lead, room[0]) <= room[2]:
                    piece, lead = self._split(lead, room[0])
                elif room[0] == 1 or room[1] == 1:
                    break
                else:  # something short beside it, else the lead itself in two pieces
                    small = min(room[0] - 1, max(1, lim.tokens // 4)), room[1] - 1, room[2]
                    piece = self._best(small) or self._filler(small)
                    if piece is None and lead[2] > (half := room[0] // 2) and self._loss(lead, half) <= room[2]:
                        piece, lead = self._split(lead, half)
            elif self.cut and room[1] == 1:
                piece = self._filler(room) or self._best(room)
            else:
                piece = self._best(room) or (self._filler(room) if self.cut else None)
            if piece is None:
                break
            taken.append(piece)
            room = room[0] - piece[2], room[1] - 1, room[2] - piece[3]
        if self.cut and room[0]:
            used, spare = lim.tokens - room[0], None
            if not lead and not taken:
                spare = lead = self._take(c := max(i for i, pieces in enumerate(self.classes) if pieces), len(self.classes[c]) - 1)
            if lead:  # as much of it as makes a power of two
                most = used + min(lead[2], room[0], lead[2] - lead[3] + room[2]) * (room[1] > 0)
                if not most:
                    raise ValueError("the limits of a sequence admit no token of a piece")
                total = 1 << (most.bit_length() - 1)
                if total > used:
                    piece, lead = self._split(lead, total - used)
                    taken.append(piece)
                    used = total
            if spare and lead:
                self._put(lead)
                lead = None
            if used & (used - 1):
                self._trim(taken, 1 << (used.bit_length() - 1))
        offset = 0
        for key, start, n, _ in taken:
            yield key, start, n, self.sequence, offset
            offset += n
        self.sequence += 1
        return lead

    def _trim(self, taken: list[tuple], total: int) -> None:
        """Give back what lies beyond *total* tokens."""
        used = sum(p[2] for p in taken)
        while used > total:
            piece = taken.pop()
            keep = max(0, piece[2] - (used - total))
            if keep:
                front, piece = self._split(piece, keep)
                taken.append(front)
            used -= piece[2]
            self._put(piece)


def pack_examples(rows: DataFrame, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Pack rows of (example_id, tokens, loss_tokens): example_id, start, length, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer = _base(), VectorPacker(limits, cut)
        names = ["example_id", "start", "length", "sequence_id", "offset"]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] + (base if i == 3 else 0) for x in found], pa.int64()) for i in range(5)], names)

        for batch in batches:
            found = []
            for key, n, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if n:
                    found += packer.add(key, n, min(loss or 0, n))
            if found:
                yield out(found)
        if found := list(packer.finish()):
            yield out(found)

    need = rows.select(F.col("example_id").cast("long"), F.col("tokens").cast("int"), F.col("loss_tokens").cast("int"))
    return need.mapInArrow(run, "example_id long, start long, length long, sequence_id long, offset long")


def _base() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 40


@lru_cache(2)
def _sentence_ends(path: str) -> np.ndarray:
    """Which ids of a tokenizer file end a sentence or a line."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab()
    out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    out[[i for piece, i in vocabulary.items() if any(c in piece for c in ".!?\n\u010a")]] = True  # U+010A: a line feed in byte-level vocabularies
    return out


def opening(ids: np.ndarray, ends: np.ndarray) -> int:
    """Tokens of a text's first sentence or line; none if that is all of it."""
    found = ends[ids]
    at = int(found.argmax()) + 1 if len(ids) else 0
    return at if at < len(ids) and found[at - 1] else 0


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens; documents are cut freely.

    *cache*: pre-tokens that a worker keeps; fewer save memory and cost time.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        encode, ends, base, packer = library_encoder(tokenizer, cache), _sentence_ends(tokenizer), _base(), VectorPacker(limits, cut=True, unseen=1)
        end = np.array([end_id], "<u4").tobytes()
        live: dict[int, list] = {}  # documents with tokens to place: doc_id, tokens, tokens left, prompt, first id held, ids from there
        n_seen = 0
        cols: list[list] = [[] for _ in names]

        def place(found: Iterator[tuple]) -> None:
            for key, start, n, sequence, offset in found:
                doc = live[key]
                doc[2] -= n
                if not doc[2]:
                    del live[key]
                at = 4 * (start - doc[4])
                loss = n - min(n, max(1, doc[3] - start))
                for c, v in zip(cols, (doc[0], start, n, zlib.crc32(doc[5][at : at + 4 * n]), doc[1], base + sequence, offset, loss)):
                    c.append(v)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
            for c in cols:
                c.clear()
            return batch

        for whole in batches:
            for batch in sliced(whole, 1):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                    prompt = opening(np.frombuffer(ids, "<u4"), ends)
                    ids += end
                    n = len(ids) // 4
                    doc = live[n_seen] = [doc_id, n, n, prompt, 0, ids]
                    place(packer.add(n_seen, n, n - prompt))
                    if doc[2] < n:  # what was placed at once is the document's front: the rest alone is held
                        doc[4], doc[5] = n - doc[2], ids[4 * (n - doc[2]) :]
                    n_seen += 1
                if cols[0]:
                    yield flush()
        place(packer.finish())
        if cols[0]:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
