"""Language of texts by a linear-chain conditional random field over words.

Each word has hashed features: the word itself if the training lexicon has it,
prefixes and suffixes of one to four letters, and letter n-grams of two and
three.  Transition weights between neighbouring words are learned too, partly
from spliced texts that switch language.  Forward-backward gives each word's
posterior; a document's language has the largest mean posterior, which is the
score.  A text is one chain: it is worked on in runs of ``RUN`` words side by
side, and forward and backward messages pass from run to run through the runs'
transfer matrices, which gives the same numbers as one long recursion.

The fit reads labelled rows in the order of a hash of the id: of each language
value, all of which are learned, at most ``FIT_DOCS`` rows and ``FIT_CHARS``
characters in all, whole texts (a row that no longer fits is passed over).
Weights take half a megabyte a language.

Defined cases: null text or text without a letter is ``und`` with score 0;
tokens without letters are skipped; a token is one word however long; with no
labelled document every text is ``und``; ties go to the alphabetically first
language; rows that repeat an id count once in the fit (the first lang and text
in order) and are each predicted; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Words that are worked on side by side; no result depends on it.
RUN = 64
FIT_DOCS = 250
#: Characters of a language's labelled texts in all, which the driver holds.
FIT_CHARS = 1_500_000
BUCKETS = 1 << 17
CACHE = 600_000
#: Tokens beyond so many letters are not kept.
_LONG = 64


def letters(token: str) -> str:
    """A token's letters in lower case."""
    word = token.lower()
    if not word.isalpha() and not (word := word.strip(".,;:!?\"'()|*#$%&-")).isalpha():
        word = "".join(filter(str.isalpha, word))
    return word


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash buckets from 1, number of features) of each non-empty word, all words' at once, word after word."""
    sizes = np.fromiter(map(len, words), "i8", len(words))
    code = np.frombuffer(("".join(words) + "   ").encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, int(ends[-1])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(n)  # letters from here to the word's end
    rolled, of, bucket = np.zeros(n, "u8"), [], []

    def put(kind: int, words_: np.ndarray, h: np.ndarray) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        of.append(words_)
        bucket.append(((h >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype("i8") + 1)

    for k in range(1, 5):
        rolled = rolled * np.uint64(1000003) + code[k - 1 : n + k - 1]
        long = np.flatnonzero(sizes >= k)
        put(10 + k, long, rolled[starts[long]])
        put(20 + k, long, rolled[ends[long] - k])
        if k in (2, 3):
            at = np.flatnonzero(left >= k)
            put(30 + k, owner[at], rolled[at])
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        i, place = np.array(known).T
        put(1, i, place.astype("u8"))
    of, bucket = np.concatenate(of), np.concatenate(bucket)
    return bucket[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, langs); bucket 0 is empty
    transitions: np.ndarray
    first: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)
    _cache: dict = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def emissions(self, split: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Row numbers of each text's tokens with letters, and the rows' exp(emission); rows are kept a worker long."""
        get, table = self._cache.get, self._rows
        done = [list(map(get, x)) for x in split]
        open_ = [i for i, d in enumerate(done) if None in d]
        missing = {t for i in open_ for t, v in zip(split[i], done[i]) if v is None}
        if missing:
            if len(self._cache) > CACHE:
                self._cache.clear()
                self._rows = None
                return self.emissions(split)
            base = 0 if self._rows is None else len(self._rows)
            word_of = {t: letters(t) for t in sorted(missing, key=len)}  # tokens to keep come first
            fresh = [w for w in word_of.values() if w]
            place = iter(range(base, base + len(fresh)))
            found = {t: next(place) if w else -1 for t, w in word_of.items()}
            keep = {t: k for t, k in found.items() if len(t) <= _LONG}
            if fresh:
                buckets, sizes = features(fresh, self.lexicon)
                summed = np.add.reduceat(self.weights[buckets], np.cumsum(sizes) - sizes, axis=0)
                rows = np.exp(summed - summed.max(1, keepdims=True)).astype("f4")
                table = rows if self._rows is None else np.vstack([self._rows, rows])
                self._rows = table[: base + sum(k >= 0 for k in keep.values())]
            self._cache.update(keep)
            for i in open_:
                done[i] = [found[t] if v is None else v for t, v in zip(split[i], done[i])]
        rows = [np.array(d, "i4") for d in done]
        return [r[r >= 0] for r in rows], table

    def predict(self, texts) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        rows, table = self.emissions([(t or "").split() for t in texts])
        sizes = np.array([len(r) for r in rows])
        out = np.zeros((len(texts), len(self.langs)))
        if sizes.sum():
            gamma = marginals(table[np.concatenate(rows)], sizes, np.exp(self.transitions), np.exp(self.first))
            has = np.flatnonzero(sizes)
            out[has] = np.add.reduceat(gamma, np.concatenate([[0], np.cumsum(sizes[has])[:-1]]), axis=0) / sizes[has, None]
        top = out.argmax(1)
        return [self.langs[k] if n else "und" for k, n in zip(top, sizes)], np.clip(out.max(1), 0, 1).tolist()

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """(token, language, posterior) of a text's tokens with letters, in order."""
        split = text.split()
        if not self.langs or not split:
            return []
        rows, table = self.emissions([split])
        if not len(rows[0]):
            return []
        gamma = marginals(table[rows[0]], np.array([len(rows[0])]), np.exp(self.transitions), np.exp(self.first))
        words = [t for t in split if any(c.isalpha() for c in t)]
        return [(t, self.langs[k], float(g[k])) for t, g, k in zip(words, gamma, gamma.argmax(1))]


def _transfers(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Of each run, the matrix that carries a forward message over its words, scaled to a largest entry of 1."""
    n = len(a)
    order = np.argsort(-lengths, kind="stable")
    begin, long = starts[order], lengths[order]
    live = np.searchsorted(-long, -np.arange(int(long[0])), side="left")  # runs longer than t
    now = np.tile(np.eye(n), (len(starts), 1, 1))
    for t, m in enumerate(live.tolist()):
        now[:m] = (now[:m].reshape(-1, n) @ a).reshape(m, n, n) * emit[begin[:m] + t][:, None, :]
        if t % 8 == 7:
            now[:m] /= now[:m].max((1, 2), keepdims=True)
    out = np.empty_like(now)
    out[order] = now / now.max((1, 2), keepdims=True)
    return out


def _borders(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray, a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run, the forward message of the word before it and the backward message of its last word."""
    before, behind = np.zeros((len(starts), len(a))), np.ones((len(starts), len(a)))
    heads = np.cumsum(counts) - counts
    several = np.argsort(-counts, kind="stable")[: int((counts > 1).sum())]
    if not len(several):
        return before, behind
    head, count = heads[several], counts[several]
    later = np.ones(len(starts), bool)
    later[heads] = False
    slot = np.cumsum(later) - 1
    carry = _transfers(emit, starts[later], lengths[later], a)
    now = first * emit[starts[head]]
    for t in range(1, int(lengths[head[0]])):
        now = (now @ a) * emit[starts[head] + t]
        now /= now.sum(1, keepdims=True)
    steps = range(1, int(count[0]))
    live = [int(np.searchsorted(-count, -k, side="left")) for k in steps]  # texts with a run k
    for k, m in zip(steps, live):
        before[head[:m] + k] = now = now[:m]
        now = np.einsum("si,sij->sj", now, carry[slot[head[:m] + k]])
        now /= now.sum(1, keepdims=True)
    for k, m in zip(reversed(steps), reversed(live)):
        run = head[:m] + k
        back = np.einsum("sij,sj->si", carry[slot[run]], behind[run])
        behind[run - 1] = back / back.sum(1, keepdims=True)
    return before, behind


def marginals(emit: np.ndarray, sizes: np.ndarray, a: np.ndarray, first: np.ndarray, run: int = RUN) -> np.ndarray:
    """Posterior of each word by forward-backward over whole texts; *emit*, *a* and *first* are exponentiated.

    With many languages transfer matrices cost more than they save: texts are then one run each.
    """
    sizes = sizes[sizes > 0]
    if len(a) > 16:
        run = int(sizes.max())
    counts = -(-sizes // run)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(sizes) - sizes, counts) + place * run
    lengths = np.minimum(run, np.repeat(sizes, counts) - place * run)
    before, behind = _borders(emit, starts, lengths, counts, a.astype("f8"), first.astype("f8"))
    enter = np.where((place == 0)[:, None], first, before @ a).astype("f4")
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, now, beta = starts[order], lengths[order], enter[order], behind[order].astype("f4")
    a = a.astype("f4")
    steps = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # runs longer than t
    alpha = np.empty_like(emit)
    for t in range(steps):
        at = starts[: live[t]] + t
        now = (now if t == 0 else now[: live[t]] @ a) * emit[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    alpha[starts + lengths - 1] *= beta
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        at = starts[:n] + t
        b = (emit[at + 1] * beta[:n]) @ a.T
        beta[:n] = b / b.sum(1, keepdims=True)
        alpha[at] *= beta[:n]
    return alpha / alpha.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = 3, seed: int = 11, length: int = 24, batch: int = 512, rate: float = 0.3) -> LanguageModel:
    """Maximum likelihood by AdaGrad over segments; a fifth of them are spliced from two texts."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    draw, n = np.random.default_rng(seed), len(langs)
    split = [t.split() for t in texts]
    seen = Counter(w for x in split for w in {t.lower() for t in x})
    lexicon = {w: i for i, w in enumerate(sorted(w for w in {letters(w) for w, c in seen.items() if c >= 5} if w))}
    number: dict[str, int] = {}
    words: list[str] = []
    segments, gold = [], []
    for x, lang in zip(split, labels):
        ids = []
        for t in x:
            if t not in number:
                word = letters(t)
                number[t] = len(words) if word else -1
                if word:
                    words.append(word)
            if number[t] >= 0:
                ids.append(number[t])
        for i in range(0, len(ids) - len(ids) % length, length):
            segments.append(ids[i : i + length])
            gold.append(langs.index(lang))
        if rest := ids[len(ids) - len(ids) % length :]:
            segments.append((rest * length)[:length])
            gold.append(langs.index(lang))
    if not segments:
        return LanguageModel(langs, np.zeros((BUCKETS, n), "f4"), np.zeros((n, n)), np.zeros(n), lexicon)
    buckets, sizes = features(words, lexicon)
    begins = np.cumsum(sizes) - sizes
    x = np.array(segments)
    y = np.repeat(np.array(gold)[:, None], length, 1)
    k = len(x) // 5
    a, b, cut = draw.integers(0, len(x), k), draw.integers(0, len(x), k), draw.integers(1, length, k)[:, None] <= np.arange(length)
    x, y = np.vstack([x, np.where(cut, x[b], x[a])]), np.vstack([y, np.where(cut, y[b], y[a])])
    w, t, f0 = np.zeros((BUCKETS, n), "f4"), np.zeros((n, n)), np.zeros(n)
    gw, gt, gf = np.full((BUCKETS, n), 1e-3, "f4"), np.full((n, n), 1e-3), np.full(n, 1e-3)
    for _ in range(epochs):
        for rows in np.split(order := draw.permutation(len(x)), range(batch, len(order), batch)):
            xs, ys, m = x[rows], y[rows], len(rows)
            unlike, which = np.unique(xs, return_inverse=True)  # a word's features are summed once a batch
            each = sizes[unlike]
            heads = np.cumsum(each) - each
            used = buckets[np.repeat(begins[unlike] - heads, each) + np.arange(int(each.sum()))]
            score = np.add.reduceat(w[used], heads, axis=0)[which.reshape(xs.shape)]
            score = score.astype("f8")
            emit = np.exp(score - score.max(2, keepdims=True))
            ea, alpha, beta = np.exp(t), np.empty_like(emit), np.ones_like(emit)
            for i in range(length):
                alpha[:, i] = (np.exp(f0) if i == 0 else alpha[:, i - 1] @ ea) * emit[:, i]
                alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
            for i in range(length - 2, -1, -1):
                beta[:, i] = (emit[:, i + 1] * beta[:, i + 1]) @ ea.T
                beta[:, i] /= beta[:, i].sum(1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(2, keepdims=True)
            pairs, after = np.zeros((n, n)), emit * beta
            for i in range(length - 1):  # summed as they come: all pairs of languages at all places would be many
                pairs += (alpha[:, i] / ((alpha[:, i] @ ea) * after[:, i + 1]).sum(1, keepdims=True)).T @ after[:, i + 1]
            pairs *= ea
            hot = np.eye(n)[ys]
            grad = (gamma - hot) / m
            flat = which.ravel()
            of_word = np.stack([np.bincount(flat, grad[:, :, c].ravel(), len(unlike)) for c in range(n)], 1)
            step = np.stack([np.bincount(used, np.repeat(of_word[:, c], each), BUCKETS).astype("f4") for c in range(n)], 1)
            step[0] = 0
            gw += step**2
            w -= rate * step / np.sqrt(gw)
            dt = pairs / m - np.bincount((ys[:, :-1] * n + ys[:, 1:]).ravel(), minlength=n * n).reshape(n, n) / m + 1e-3 * t
            df = (gamma[:, 0] - hot[:, 0]).mean(0)
            gt += dt**2
            gf += df**2
            t -= rate * dt / np.sqrt(gt)
            f0 -= rate * df / np.sqrt(gf)
    return LanguageModel(langs, w, t, f0, lexicon)


def fit(docs: DataFrame, per_lang: int = FIT_DOCS, chars: int = FIT_CHARS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit to a hash sample of labelled documents; only ids of bounded number are broadcast, only their texts collected."""
    key, lang = F.col(id_col).cast("long").alias("__key"), F.col(lang_col).cast("string").alias("__lang")
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(key, lang)
    counts = named.groupBy("__lang").count().collect()
    if not counts:
        return train([], [])
    hashed = F.xxhash64("__key")
    place = F.pmod(hashed, F.lit(1_000_000_000)) / 1e9
    rates = docs.sparkSession.createDataFrame([(r["__lang"], (1.5 * per_lang + 50) / r["count"]) for r in counts], "__lang string, __rate double")
    chosen = named.join(F.broadcast(rates), "__lang").where(place < F.col("__rate")).groupBy("__key").agg(F.min("__lang").alias("__lang"))
    texts = docs.select(key, F.col(text_col).alias("__text")).where("__text is not null")
    found = texts.join(F.broadcast(chosen), "__key").groupBy("__key", "__lang").agg(F.min("__text").alias("__text")).orderBy("__lang", place, "__key")
    sample, lang, rows, left = [], None, 0, 0
    for r in found.toLocalIterator():
        if r["__lang"] != lang:
            lang, rows, left = r["__lang"], per_lang, chars
        if rows and len(r["__text"]) <= left:
            rows, left = rows - 1, left - len(r["__text"])
            sample.append(r)
    sample.sort(key=lambda r: r["__key"])
    return train([r["__text"] for r in sample], [r["__lang"] for r in sample])


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for whole in batches:
            for batch in sliced(whole, 1):
                lang, score = shared.value.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
