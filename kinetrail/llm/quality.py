"""Quality classifier: random Fourier features of document statistics.

A text becomes some twenty statistics (sizes, character classes, repetition);
random Fourier features turn their Gaussian kernel into inner products; ridge
scores come from the normal equations, summed over partitions; an isotonic
fit on rows the ridge has not seen turns scores into probabilities.

The fit reads a sample of at most ``FIT_ROWS`` labelled rows, the lowest by a
hash of the id; scoring is one pass over the texts.  Defined cases: null text
is empty and is scored as such; without labels of both kinds every score is
the labels' mean (0.5 without labels); null labels are skipped, and so is an
id labelled both ways; an id that repeats in the documents counts once in the
fit (its least statistics) and each of its rows is scored; equal scores are one
point of the isotonic fit; empty tables give no rows; very long texts are read
whole; other columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dispose, stored

FIT_ROWS = 8000
FEATURES = 192
RIDGE = 1e-3
WIDTHS = (0.5, 1.0, 2.0)
FIT_PARTS = 8

_CLASS = np.full(256, 7)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6


def statistics(text: str) -> list[float]:
    """Document statistics; all finite for any text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), "u1")
    n = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    space, line, digit, upper, lower, high, mark, symbol = np.bincount(_CLASS, weights=counts, minlength=8).tolist()
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    same = sum(map(eq, words, words[1:]))
    unlike = len(set(words))
    letters = max(1.0, upper + lower)
    odd = counts.copy()
    odd[[*range(48, 58), *range(65, 91), *range(97, 123), 32, 10, 46, 44, *range(128, 256)]] = 0
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(raw) / w if len(raw) / w < 100 else 100.0,
        space / n,
        np.sqrt(line / n),
        np.sqrt(digit / n),
        upper / letters,
        (upper + lower + high) / n,
        high / n,
        np.sqrt(mark / n),
        np.sqrt(symbol / n),
        np.sqrt(odd.max() / n),
        counts[33] / w if counts[33] < 4 * w else 4.0,
        counts[124] / w if counts[124] < 4 * w else 4.0,
        np.sqrt(same / w),
        np.log((unlike + 1) / (len(words) + 1)),
        np.log((unlike + 1) / (len(words) + 1)) / np.log(w + 2),
        1 - len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)),
        np.log1p(max(map(len, words), default=0)),
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.frequencies, self.phases) @ self.weights

    def score(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        raw = self.raw(np.array([statistics(t or "") for t in texts]).reshape(len(texts), -1))
        return 0.98 * np.interp(raw, self.knots, self.values) + 0.02 / (1 + np.exp(-np.clip(6 * raw - 3, -30, 30)))


def fourier(x, mean, scale, frequencies, phases) -> np.ndarray:
    """sqrt(2/D) cos(Wx + b), and a constant."""
    z = np.cos(np.clip((x - mean) / scale, -6, 6) @ frequencies + phases) * np.sqrt(2 / len(phases))
    return np.hstack([z, np.ones((len(z), 1))])


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots are the blocks' ends. Tied scores are one point."""
    points, back = np.unique(raw, return_inverse=True)
    weight = np.bincount(back).astype(float)
    mean = np.bincount(back, weights=label) / weight
    blocks: list[list] = []
    for x, w, m in zip(points, weight, mean):
        blocks.append([x, x, w, m])
        while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
            _, b, w1, m1 = blocks.pop()
            blocks[-1][1:] = [b, blocks[-1][2] + w1, (blocks[-1][2] * blocks[-1][3] + w1 * m1) / (blocks[-1][2] + w1)]
    knots = np.array([v for b in blocks for v in b[:2]])
    return knots, np.array([v for b in blocks for v in (b[3], b[3])])


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__key, part, label, text) of the *rows* labelled documents whose ids hash lowest; only their ids are broadcast.

    An id labelled both ways is left out; an id that repeats in *docs* gives a row each time.
    """
    key = F.col(id_col).cast("long")
    good = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull()).select(key.alias("__key"), F.col(label_col).cast("double").alias("label"))
    rate = (1.2 * rows + 200) / max(1, good.count())  # a hash threshold first, so that no task sorts many
    low = good.where(F.pmod(F.xxhash64("__key"), F.lit(1_000_000_000)) < F.lit(1e9 * rate))
    one = low.groupBy("__key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = one.orderBy(F.pmod(F.xxhash64("__key"), F.lit(1_000_000_000)), "__key").limit(rows)
    texts = docs.select(key.alias("__key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "__key").select("__key", F.pmod(F.xxhash64("__key", F.lit(1)), F.lit(4)).alias("part"), "label", "text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = FIT_ROWS, seed: int = 7) -> QualityModel:
    """Ridge weights from three quarters of the sample, kernel width and calibration from the rest."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([statistics(t) for t in b.column(3).to_pylist()], pa.list_(pa.float64()))], ["__key", "part", "label", "x"])

    every = sample_labelled(docs, labels, label_col, rows).mapInArrow(describe, "__key long, part long, label double, x array<double>")
    data = stored(every.groupBy("__key", "part", "label").agg(F.min("x").alias("x")).drop("__key"), "quality-fit")
    d = len(statistics(""))
    stats = data.agg(F.count("*").alias("n"), F.avg("label").alias("y"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d))).first()
    if not stats.n or stats.y in (0.0, 1.0):
        dispose(data)
        return QualityModel(*[np.zeros(1)] * 7, constant=0.5 if not stats.n else stats.y)
    mean, scale = (np.array([stats[f"{k}{i}"] for i in range(d)]) for k in "ms")
    scale[scale < 1e-9] = 1.0
    draw = np.random.default_rng(seed)
    frequencies, phases = draw.standard_normal((d, FEATURES)) / np.sqrt(d), draw.uniform(0, 2 * np.pi, FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This partition's Z'Z and Z'y for each width."""
        a, b = np.zeros((len(WIDTHS), FEATURES + 1, FEATURES + 1)), np.zeros((len(WIDTHS), FEATURES + 1))
        for batch in batches:
            x, y = np.array(batch.column(1).to_pylist()).reshape(-1, d), batch.column(0).to_numpy()
            for k, width in enumerate(WIDTHS):
                z = fourier(x, mean, scale, frequencies / width, phases)
                a[k] += z.T @ z
                b[k] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    parts = data.where("part <> 0").select("label", "x").coalesce(FIT_PARTS).mapInArrow(sums, "a binary, b binary").collect()  # FIT_PARTS at most
    a = sum(np.frombuffer(p.a).reshape(len(WIDTHS), FEATURES + 1, FEATURES + 1) for p in parts)
    b = sum(np.frombuffer(p.b).reshape(len(WIDTHS), FEATURES + 1) for p in parts)
    rest = data.where("part = 0").select("label", "x").collect() or data.select("label", "x").collect()  # the bounded sample
    dispose(data)
    x, y = np.array([r.x for r in rest]), np.array([r.label for r in rest])
    best = None
    for k, width in enumerate(WIDTHS):
        n = max(1.0, a[k][-1, -1])
        w = np.linalg.solve(a[k] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), b[k])
        model = QualityModel(mean, scale, frequencies / width, phases, w, np.zeros(1), np.zeros(1))
        raw = model.raw(x)
        loss = np.mean((np.clip(raw, 0, 1) - y) ** 2)
        if best is None or loss < best[0]:
            best = loss, model, raw
    _, model, raw = best
    model.knots, model.values = isotonic(raw, y)
    return model


def score_column(docs: DataFrame, model, text: Column) -> Column:
    """The model's score of a text column, in Arrow batches; the model goes out as a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return score(text)
