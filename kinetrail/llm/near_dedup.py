"""Near-duplicate classes by HyperMinHash, confirmed on full shingle sets.

1. Each text becomes a set of hashed word shingles, a fingerprint of that set,
   and a HyperMinHash sketch: the set's hashes are dealt to 256 buckets by
   their first bits, and a bucket keeps its minimum as a leading-zero count
   and ten mantissa bits.  Empty buckets borrow from others along fixed random
   probe orders, so that registers of two sketches agree with probability J.
2. Rows with equal fingerprints are one class, found by a pre-aggregated
   minimum; only class representatives go on.
3. Runs of six registers are band keys.  In each bucket of equal keys every
   member is paired with the smallest one: linear in the bucket's size.  Pairs
   whose collision-corrected estimate could still mean a link are confirmed on
   the full sets, and links are contracted to components.
4. Buckets that still hold several components are searched for links between
   them, blockwise, blocks being bounded by members and by shingles: a task
   compares the sketches of two blocks and takes only pairs whose first common
   band this is.  Where those that could be links are few (two for each member
   of the bucket), they are confirmed as pairs.  Other buckets are searched
   by tasks with the sets at hand, which give links between components they
   have not joined yet.  Nothing is dropped, and linked pairs are never all
   listed.

At similarity J the chance that no band agrees is (1 - J^6)^42: 6e-9 at 0.85,
5e-6 at 0.8.  An estimate rules a pair out only six standard errors below the
threshold.

Defined cases: null text, and text without words, has an empty set and is
linked with nothing; fewer words than a shingle are one shingle; rows that
share an id count as one document; a null id is linked with nothing and its
component is null; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_shuffles, dispose, sliced, stored

BUCKETS = 256
BAND, BANDS = 6, 42
MANTISSA = 10
SHINGLE = 5
#: Members, and shingles in all, that a block of a bucket should have at most.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Hopeful pairs that a bucket may have for each of its members before sets are sent to its tasks.
CANDIDATES = 2
#: Rows a broadcast may have; beyond it the same join is a shuffle.
BROADCAST_ROWS = 500_000
#: Pairs of one key that a task should have at most.
HOT_PAIRS = 256
_CACHE = 200_000
_words: dict[bytes, int] = {}

_SKETCH = "id long, n int, f1 long, f2 long, registers binary"


def _forget() -> None:
    """At a task's end: workers live on, and other stages want their memory."""
    _words.clear()
    gc.enable()
    gc.collect()


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(8)
def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype="u8") * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z in lower case, words parted by ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    if len(_words) > _CACHE:
        _words.clear()
    hashes = [_words.get(w) for w in words]
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = _words[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    h = np.array(hashes, "u8")
    c = _multipliers(size, 3)
    if len(h) < size:
        return _mix(np.array([(h * c[: len(h)]).sum(dtype="u8") + np.uint64(len(h))], "u8"))
    n = len(h) - size + 1
    total = h[:n] * c[0]
    for k in range(1, size):
        total += h[k : k + n] * c[k]
    return np.unique(_mix(total))


@lru_cache(1)
def _probes() -> np.ndarray:
    draw = np.random.default_rng(17)
    return np.stack([draw.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a sorted, non-empty set of hashes: 6 bits of leading zeros and 10 of mantissa a bucket."""
    bucket = (hashes >> np.uint64(56)).astype("i4")
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted, so a bucket's first is its minimum
    rest = hashes[first] << np.uint64(8)
    zeros = np.minimum(64 - np.frexp(rest.astype("f8"))[1], 56).astype("u8")
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(BUCKETS, "u2")
    full = np.zeros(BUCKETS, bool)
    full[bucket[first]] = True
    out[bucket[first]] = (zeros << np.uint64(MANTISSA)) | mantissa
    empty = np.flatnonzero(~full)
    if len(empty):
        probes = _probes()[empty]
        out[empty] = out[probes[np.arange(len(empty)), full[probes].argmax(1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    runs = sketches[:, : BAND * BANDS].reshape(len(sketches), BANDS, BAND).astype("u8") + np.uint64(1)
    return _mix((runs * _multipliers(BAND, 5)).sum(2, dtype="u8") + _multipliers(BANDS, 9)).astype("i8")


@lru_cache(1)
def _collisions() -> np.ndarray:
    """Chance that unlike sets' registers agree, by log2 of the set size: the same bin for both minima."""
    zeros = np.arange(0, 50)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(2**MANTISSA) / 2**MANTISSA)
    width = 2.0 ** -(zeros + 1 + MANTISSA)
    out = []
    for k in range(0, 41):
        load = max(1.0, 2.0**k / BUCKETS)
        p = np.exp(-load * low) * -np.expm1(-load * width)
        out.append(float((p**2).sum() / max(p.sum(), 1e-300) ** 2))
    return np.array(out)


def estimate(same: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from the share of agreeing registers and the sets' mean size."""
    c = np.interp(np.log2(np.maximum(n, 1)), np.arange(41), _collisions())
    return (same - c) / (1 - c)


def hopeful(same: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair with such agreement and set sizes could reach the threshold."""
    t = percent / 100
    least = np.minimum(a, b)
    error = np.sqrt(t * (1 - t) / np.minimum(least, BUCKETS))
    return (100 * least >= percent * np.maximum(a, b)) & (estimate(same, (a + b) / 2) >= t - 6 * error)


def band_column(registers_: str) -> Column:
    """Band keys of sketches, for class representatives alone."""

    @F.pandas_udf("array<long>")
    def keys(r: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(np.frombuffer(b"".join(r), "u2").reshape(len(r), BUCKETS))))

    return keys(registers_)


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), fingerprint and registers of each row; null sketches for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        gc.disable()
        for whole in batches:
            for batch in sliced(whole, 1):
                sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
                prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([p and int.from_bytes(p[:8], "little", signed=True) for p in prints], pa.int64()),
                        pa.array([p and int.from_bytes(p[8:], "little", signed=True) for p in prints], pa.int64()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "n", "f1", "f2", "registers"],
                )

        _forget()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SKETCH)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the wanted documents, their texts read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for whole in batches:
            for batch in sliced(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).astype("i8") for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "shingles"])
        _forget()

    wanted = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return rows.mapInArrow(run, "id long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b); the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes; each
    round is written to shared storage.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step = stored(small, "cc")
        dispose(now)
        now, after = step, state(step)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _spread_join(pairs: DataFrame, side: DataFrame, key: str, by: str, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Join on *key* with the pairs of a hot key dealt to several tasks by *by*, and its row of *side* sent to each.

    Keys with at least a thousandth of the pairs are hot: a thousand at most.
    *counts*: (key, count) of the pairs, where it is known.
    """
    total = pairs.count() if total is None else total
    counts = pairs.groupBy(key).count() if counts is None else counts
    least = max(HOT_PAIRS, total // 1000)
    hot = counts.where(F.col("count") > least).select(key, F.least(F.ceil(F.col("count") / HOT_PAIRS), F.ceil(F.col("count") * 2000 / F.lit(max(1, total))) + 1).cast("int").alias("__parts"))
    hot = F.broadcast(stored(hot, "hot"))
    dealt = pairs.join(hot, key, "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("__parts"))).cast("int")).drop("__parts")
    copies = side.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stored(_sets(docs, ids, id_col, text_col), "sets")
    two = _spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a", "b").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    links = two.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb") - inter).alias("u"))
    links = stored(links.where(F.lit(100) * F.col("i") >= F.lit(percent) * F.col("u")).select("a", "b").distinct(), "links")
    dispose(sets)
    return links


def _star_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members with its smallest one, where sizes and estimate leave hope."""
    rows = reps.select("id", F.explode("bands").alias("key"))
    buckets = stored(rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("count")).where("count > 1"), "buckets")
    total = buckets.agg(F.sum("count")).first()[0] or 0
    with_least = _spread_join(rows, buckets.select("key", "a"), "key", "id", buckets.select("key", "count"), total)
    pairs = stored(with_least.where("id <> a").select("a", F.col("id").alias("b")).distinct(), "star")
    dispose(buckets)
    side = lambda k: reps.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("registers").alias(f"r{k}"))

    @F.pandas_udf("boolean")
    def hope(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        grid = lambda r: np.frombuffer(b"".join(r), "u2").reshape(len(r), BUCKETS)
        return pd.Series(hopeful((grid(ra) == grid(rb)).mean(1), na.to_numpy(), nb.to_numpy(), percent))

    joined = _spread_join(pairs, side("a"), "a", "b").join(side("b"), "b")
    sized = joined.where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    hopeful_pairs = stored(sized.where(hope("ra", "rb", "na", "nb")).select("a", "b"), "pairs")
    dispose(pairs)
    return hopeful_pairs


def _mixed(reps: DataFrame, comps: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(id, component, band, key, blocks) of the members of buckets (of *keys*, if given) that hold several components."""
    named = reps.join(comps, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), "bands")
    rows = named.select("id", "n", "component", F.posexplode("bands").alias("band", "key"))
    if keys is not None:
        rows = rows.join(keys, "key", "left_semi")
    sizes = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("count"), F.sum("n").alias("shingles"))
    # A bucket of many members or long ones is dealt to blocks.
    blocks = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = stored(sizes.where("low < high").select("key", "count", blocks.alias("blocks")), "mixed-keys")
    total = mixed.agg(F.sum("count")).first()[0] or 0
    members = stored(_spread_join(rows, mixed.select("key", "blocks"), "key", "id", mixed.select("key", "count"), total).drop("n"), "mixed")
    dispose(mixed)
    return members


def _spread(members: DataFrame) -> DataFrame:
    """Each member goes to the tasks of its block with every block."""
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("id", "component", "band", "key", "blocks", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _cross_links(docs: DataFrame, reps: DataFrame, near: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links between the components that share a bucket.

    First the sketches alone are compared; a bucket with more hopeful pairs
    than ``CANDIDATES`` for each member is searched with the sets at hand.
    """
    first = components(near)
    members = _mixed(reps, first)
    sketches = reps.select("id", "n", "registers")
    found = _spread(members).join(sketches, "id").groupBy("key", "low", "high").applyInArrow(lambda table: _block_pairs(table, percent), "a long, b long, key long")
    found = stored(found, "cross-pairs")
    for table in (members, first):
        dispose(table)
    candidates = stored(found.where("a is not null").select("a", "b").distinct(), "cross-candidates")
    links = _confirmed(docs, candidates, percent, id_col, text_col)
    keys = stored(found.where("a is null").select("key").distinct(), "cross-keys")
    for table in (candidates, found):
        dispose(table)
    if not keys.limit(1).count():
        return links
    now = components(near.unionByName(links))
    members = _mixed(reps, now, keys)
    sets = _sets(docs, members.select("id").distinct(), id_col, text_col)
    full = stored(sets.join(reps.select("id", "registers"), "id"), "mixed-sets")

    def link(table: pa.Table) -> pa.Table:
        rest = _block_links(table, percent)
        return pa.table({"a": pa.array([x for x, _ in rest], pa.int64()), "b": pa.array([y for _, y in rest], pa.int64())})

    rest = stored(_spread(members).join(full, "id").groupBy("key", "low", "high").applyInArrow(link, "a long, b long"), "cross")
    both = stored(links.unionByName(rest), "cross-links")
    for table in (now, keys, members, full, links, rest):
        dispose(table)
    return both


def _hopeful_of(i: int, label, n, sketches, mine, low: int, high: int, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, agreement) of those rows of other components with which row i could be linked and first agrees in this band."""
    ok = (label != label[i]) & (mine == high)
    if low == high:
        ok[: i + 1] = False
    others = np.flatnonzero(ok & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
    if not len(others):
        return others, np.zeros(0)
    equal = sketches[others] == sketches[i]
    same = equal.mean(1)
    agree = equal[:, : BAND * BANDS].reshape(len(others), BANDS, BAND).all(2)
    good = (agree.argmax(1) == band) & hopeful(same, n[others], n[i], percent)
    return others[good], same[good]


def _block_pairs(table: pa.Table, percent: int) -> pa.Table:
    """The hopeful pairs of a block pair between components; if they are many, a row without a and b instead."""
    ids, comps = table["id"].to_numpy(), table["component"].to_numpy()
    mine, n = table["mine"].to_numpy(), table["n"].to_numpy().astype("i8")
    low, high, band, key, blocks = (table[c][0].as_py() for c in ("low", "high", "band", "key", "blocks"))
    sketches = np.frombuffer(b"".join(table["registers"].to_pylist()), "u2").reshape(len(ids), BUCKETS)
    a, b, left = [], [], CANDIDATES * len(ids) // blocks
    for i in np.flatnonzero(mine == low) if len(set(comps.tolist())) > 1 else ():
        others, _ = _hopeful_of(i, comps, n, sketches, mine, low, high, band, percent)
        left -= len(others)
        if left < 0:
            return pa.table({"a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64()), "key": pa.array([key], pa.int64())})
        a += [int(ids[i])] * len(others)
        b += ids[others].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "key": pa.array([key] * len(a), pa.int64())})


def _block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links of a block pair between components not joined before, each confirmed on the sets."""
    ids, comps = table["id"].to_pylist(), table["component"].to_pylist()
    if len(set(comps)) < 2:
        return []
    mine, low, high, band = table["mine"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py(), table["band"][0].as_py()
    sketches = np.frombuffer(b"".join(table["registers"].to_pylist()), "u2").reshape(len(ids), BUCKETS)
    sets = [x.values.to_numpy(zero_copy_only=False) for x in table["shingles"]]
    n = np.array([len(s) for s in sets])
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    code = {c: i for i, c in enumerate(parent)}
    label = np.array([code[c] for c in comps])
    found = []
    for i in np.flatnonzero(mine == low):
        others, same = _hopeful_of(i, label, n, sketches, mine, low, high, band, percent)
        for j in others[np.argsort(-same, kind="stable")]:
            a, b = root(comps[i]), root(comps[j])
            if a == b:
                continue
            inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * inter >= percent * (n[i] + n[j] - inter):
                parent[max(a, b)] = min(a, b)
                found.append((ids[i], ids[j]))
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row."""
    full = stored(sketch_documents(docs, id_col, text_col), "sketches")
    sketches = stored(full.drop("registers"), "prints")
    usable = sketches.where("n > 0 and id is not null")
    classes = stored(usable.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    chosen = classes.select(F.col("rep").alias("id"), "f1", "f2")
    reps = stored(full.where("n > 0 and id is not null").join(chosen, ["id", "f1", "f2"], "left_semi").dropDuplicates(["id", "f1", "f2"]).select("id", "n", "registers", band_column("registers").alias("bands")), "reps")
    dispose(full)
    pairs = _star_pairs(reps, percent)
    near = _confirmed(docs, pairs, percent, id_col, text_col)
    dispose(pairs)
    clean_shuffles(docs.sparkSession)
    cross = _cross_links(docs, reps, near, percent, id_col, text_col)
    dispose(reps)
    comps = components(near.unionByName(cross))
    named = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "size", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named")
    for table in (near, cross, comps, classes):
        dispose(table)
    clean_shuffles(docs.sparkSession)
    # Fingerprints of at least a thousandth of the rows, a thousand at most, go to every task; the others are shuffled.
    total = sketches.count()
    hot = F.broadcast(named.where(F.col("size") * 1000 > total).select("f1", "f2", F.col("component").alias("hot")))
    rows = sketches.select("id", "n", "f1", "f2").join(hot, ["f1", "f2"], "left")
    cold = rows.where("hot is null").join(named.where(F.col("size") * 1000 <= total).select("f1", "f2", F.col("component").alias("cold")), ["f1", "f2"], "left")
    done = rows.where("hot is not null").withColumn("cold", F.lit(None).cast("long")).unionByName(cold)
    component = F.coalesce("hot", "cold", "id")
    return done.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """*docs* without the rows whose group has a smaller id; all columns stay."""
    gone = stored(near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col(id_col).alias("__gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
