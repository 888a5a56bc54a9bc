"""Registered queries that SQL cannot say, against plain loops over small tables."""

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions.geometry import near_pairs, pairwise_distances
from kinetrail.operators import clustering, landmarks, merging
from kinetrail.plans import catalogue, structures
from kinetrail.plans import fixtures as fx
from kinetrail.plans.fixtures import CELL

from .test_networks import flow_clusters
from .test_whole import peaks_of

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def distance(p, q):
    """As the engine defines it: p to the centroid, q wrapped."""
    return float(np.linalg.norm(CELL.wrap_array(np.array(q) - p + CELL.centroid) - CELL.centroid))


def vectors(spark):
    return sorted((r.vec_id, r.label, np.array(r.v)) for r in fx.vectors(spark, DATA).collect())


def leaders(rows, threshold):
    """Leader clustering by loops: (centers, members)."""
    old, size, last = [v for v in rows], [1.0] * len(rows), None
    while True:
        centers, n = [], []
        for v, m in zip(old, size):
            cosine = [c @ v / np.linalg.norm(c) / np.linalg.norm(v) for c in centers]
            k = max(range(len(cosine)), key=lambda i: (cosine[i], -i), default=None)
            if k is None or cosine[k] < threshold:
                centers.append(v)
                n.append(m)
            else:
                centers[k] = (centers[k] * n[k] + v) / (n[k] + m)
                n[k] += m
        old, size = centers, n
        if len(centers) == last:
            return centers, n
        last = len(centers)


def test_leader_clusters(spark):
    centers, n = leaders([v for _, _, v in vectors(spark)], 0.3)
    got = catalogue.leader_clusters(spark, DATA).orderBy("center").collect()
    assert [r.n for r in got] == n and np.allclose([r.norm for r in got], [np.linalg.norm(c) for c in centers], atol=2e-6)
    parts = catalogue.leader_clusters_two_level(spark, DATA).collect()
    assert sum(r.n for r in parts) == sum(n)


def counts(spark):
    return {(r.src, r.dst): r.n_ij for r in catalogue._threshold(spark, DATA).collect()}


def test_markov_clusters_of_jumps(spark):
    m = np.eye(25)
    for (a, b), v in counts(spark).items():
        m[a, b] += v
    found = {}
    for r in catalogue.mcl_clusters(spark, DATA).collect():
        found.setdefault(r.cluster, set()).add(r.site_id)
    assert [tuple(sorted(found[k])) for k in range(len(found))] == flow_clusters(m, 2, 2.0)


def test_sites_merged_by_dynamics(spark):
    centers = {r.id: np.array([r.x, r.y, r.z]) for r in fx.centers(spark, DATA).collect()}
    near = lambda a, b: 0.0 if a == b else distance(centers[min(a, b)], centers[max(a, b)])
    m = np.zeros((25, 25))
    for (a, b), v in counts(spark).items():
        if near(a, b) <= 6.0:
            m[a, b] = v
    if (np.diag(m) == 0).any():
        with pytest.raises(ValueError):
            catalogue.merge_by_dynamics(spark, DATA).collect()
        return
    clusters = flow_clusters(m, 2, 2.0)
    got = {r.site_id: np.array([r.cx, r.cy, r.cz]) for r in catalogue.merge_by_dynamics(spark, DATA).collect()}
    assert len(got) == len(clusters)
    for k, members in enumerate(sorted(clusters)):
        pivot = centers[members[0]]
        mean = np.mean([CELL.wrap_array(centers[s] - pivot + CELL.centroid) for s in members], axis=0)
        assert np.allclose(got[k], CELL.wrap_array(mean - CELL.centroid + pivot), atol=2e-6)


def test_near_edges_are_those_of_all_pairs(spark):
    sites = catalogue._nation_sites(spark, DATA)
    edges = catalogue._threshold(spark, DATA)
    every = pairwise_distances(merging._centers(sites), CELL)
    for most in (0.0, 1.5, 2.5, 6.0):
        want = {(r.i, r.j) for r in every.where(F.col("distance") <= most).collect()}
        got = {(r.src, r.dst) for r in merging.distance_filtered(edges, sites, CELL, most).collect()}
        assert got == want & set(counts(spark))


def hull(p):
    """(volume, area): triples with all points on one side are facets; coplanar points make their hull from triangles about it."""
    p = np.unique(np.round(p, 9), axis=0)
    center, volume, area, seen = p.mean(0), 0.0, 0.0, set()
    for a, b, c in combinations(range(len(p)), 3):
        n = np.cross(p[b] - p[a], p[c] - p[a])
        size = np.linalg.norm(n)
        if size < 1e-9:
            continue
        side = (p - p[a]) @ (n / size)
        if (side > 1e-7).any() and (side < -1e-7).any():
            continue
        on = tuple(np.flatnonzero(np.abs(side) <= 1e-7))
        if on in seen:
            continue
        seen.add(on)
        q = p[list(on)] - p[a]
        u = (p[b] - p[a]) / np.linalg.norm(p[b] - p[a])
        flat = np.column_stack([q @ u, q @ np.cross(n / size, u)])
        angle = np.arctan2(*(flat - flat.mean(0)).T[::-1])
        ring = flat[np.argsort(angle)]
        edge = [k for k in range(len(ring))]
        # Gift wrapping by dropping points inside the polygon.
        keep = [k for k in edge if not inside(ring, k)]
        x, y = ring[keep].T
        face = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
        area += face
        volume += face * abs((center - p[a]) @ (n / size)) / 3
    return volume, area


def turn(u, v):
    return u[0] * v[1] - u[1] * v[0]


def inside(ring, k):
    rest = np.delete(ring, k, 0)
    for i, j, m in combinations(range(len(rest)), 3):
        d = [turn(rest[y] - rest[x], ring[k] - rest[x]) for x, y in ((i, j), (j, m), (m, i))]
        if abs(turn(rest[j] - rest[i], rest[m] - rest[i])) > 1e-9 and (min(d) >= -1e-9 or max(d) <= 1e-9):
            return True
    return False


def test_site_volumes(spark):
    rows = sorted((r.site, r.frame, r.mobile, r.x, r.y, r.z) for r in fx.positions(spark, DATA).where("site >= 0").collect() if r.mobile % 4 == 0)
    table = spark.createDataFrame([(s, f, m, x, y, z) for s, f, m, x, y, z in rows], "site int, frame long, mobile long, x double, y double, z double")
    from kinetrail.operators.positions import accessible_volumes

    got = {r.site: (r.volume, r.area) for r in accessible_volumes(table, CELL).collect()}
    for site in {r[0] for r in rows}:
        p = np.array([r[3:] for r in rows if r[0] == site])
        found = []
        for k in range(8):
            moved = CELL.wrap_array(p - p[k * len(p) // 8] + CELL.centroid)
            found.append(hull(moved))
        solid = [x for x in found if x[0] > 1e-9]
        want = min(solid) if solid else (None, None)
        assert got[site] == pytest.approx(want, abs=1e-6)


def test_types_by_votes_of_density_peaks(spark):
    rows = vectors(spark)
    x = np.array([v for _, _, v in rows])
    cov = np.cov(x.T)
    w, axes = np.linalg.eigh(cov)
    order = np.argsort(-w)
    k = max(2, int(np.searchsorted(np.cumsum(w[order]) / w.sum(), 0.9 - 1e-12)) + 1)
    peaks = peaks_of(x @ axes[:, order[:k]], 0.02)
    decision = sorted(((-d * far, rows[i][0]) for i, (d, far, _) in peaks.items()))[:30]
    got = structures.type_decisions(spark, DATA).orderBy("rank").collect()
    assert np.allclose([r.decision for r in got], [-d for d, _ in decision], rtol=1e-4, atol=2e-6)
    curve = [-d for d, _ in decision]
    n, hi, lo = len(curve) - 1, curve[0], curve[-1]
    elbow = max(range(len(curve)), key=lambda i: (round(abs(n * (curve[i] - hi) - i * (lo - hi)), 9), -i))
    at = {r[0]: i for i, r in enumerate(rows)}
    label = {at[s]: c for c, (_, s) in enumerate(decision[: max(1, min(elbow, 20))])}

    def follow(i):
        while i not in label:
            i = peaks[i][2]
            if i is None:
                return 0
        return label[i]

    votes = {}
    for i, (_, site, _) in enumerate(rows):
        votes.setdefault(site, []).append(follow(i))
    for r in catalogue.pca_types(spark, DATA).collect():
        v = votes[r.site_id]
        top = max(set(v), key=lambda c: (v.count(c), -c))
        assert (r.site_type, r.share) == (top, pytest.approx(v.count(top) / len(v), abs=2e-6))


def test_landmark_analysis(spark):
    network, frames = structures.landmark_inputs(spark, DATA)
    mid, steep = structures.LANDMARK_OPTIONS["cutoff_midpoint"], structures.LANDMARK_OPTIONS["cutoff_steepness"]
    cut = landmarks.cutoff_point(mid, steep)
    still = {r.atom_id: np.array([r.x, r.y, r.z]) for r in network.atoms.where("is_static").collect()}
    sites = {r.site_id: (np.array([r.cx, r.cy, r.cz]), r.vertices) for r in network.sites.collect()}
    moving = sorted((r.frame, np.array([r.x, r.y, r.z])) for r in frames.where("atom_id = 1000").collect())
    moving = sorted(moving, key=lambda r: r[0])
    x = np.zeros((len(moving), 25))
    for i, (_, p) in enumerate(moving):
        p = CELL.wrap_array(p)
        for k, (c, vertices) in sites.items():
            ratio = [distance(p, CELL.wrap_array(still[v])) / distance(c, still[v]) for v in vertices]
            if max(ratio) <= cut:
                x[i, k] = np.exp(np.mean([-np.log1p(np.exp(steep * (r - mid))) for r in ratio]))
    rows = [v for v in x if v.any()]
    centers, _ = leaders(rows, 0.6)

    def assign(centers):
        out = []
        for v in x:
            s = [abs(v @ c) / np.linalg.norm(v) / np.linalg.norm(c) for c in centers] if v.any() else [0.0]
            k = max(range(len(s)), key=lambda i: (s[i], -i))
            out.append((k, s[k]) if s[k] >= 0.7 else (-1, 0.0))
        return out

    first = [k for k, _ in assign(centers)]
    least = max(1, int(0.005 * sum(k >= 0 for k in first)))
    kept = [c for k, c in enumerate(centers) if first.count(k) >= least]
    want = assign(kept)
    got = structures.landmark_analysis(spark, DATA).orderBy("frame").collect()
    assert [r.frame for r in got] == [f for f, _ in moving] and len(kept) > 1
    assert [r.site for r in got] == [k for k, _ in want]
    assert np.allclose([r.confidence for r in got], [s for _, s in want], atol=2e-6)
    for site in range(len(kept)):
        p = np.array([CELL.wrap_array(q) for (_, q), (k, _) in zip(moving, want) if k == site])
        mean = CELL.wrap_array(p - p[0] + CELL.centroid).mean(0)
        mine = next(r for r in got if r.site == site)
        assert np.allclose((mine.cx, mine.cy, mine.cz), CELL.wrap_array(mean - CELL.centroid + p[0]), atol=2e-6)


def test_grid_of_a_rigid_lattice(spark):
    from kinetrail.functions.geometry import Cell

    draw = np.random.default_rng(8)
    wide = Cell.of(np.diag([30.0, 28.0, 33.0]))
    at = [(i, *draw.uniform(0, 28, 3).tolist()) for i in range(200)]
    static = spark.createDataFrame(at, "static_idx int, x double, y double, z double")
    mobile = spark.createDataFrame([(f, m, *draw.uniform(0, 28, 3).tolist()) for f in range(3) for m in range(40)], "frame long, mobile long, x double, y double, z double")
    marks = spark.createDataFrame([(k, *p[1:], [p[0], at[k + 1][0]]) for k, p in enumerate([(i, x + 1.0, y, z) for i, x, y, z in at[:60]])], "site_id int, cx double, cy double, cz double, vertices array<int>")
    reference = landmarks.reference_distances(marks, static, wide).where("d0 < 2").groupBy("landmark").agg(F.first("vertex").alias("vertex"), F.first("d0").alias("d0")).withColumn("n_vertices", F.lit(1))
    found = landmarks.landmark_vectors(mobile, static, reference, wide, 1.5, 30.0)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    by_frame = static.crossJoin(spark.range(3).withColumnRenamed("id", "frame"))
    again = landmarks.landmark_vectors(mobile, by_frame, reference, wide, 1.5, 30.0)
    one, two = ({tuple(r)[:3]: r.value for r in t.select("frame", "mobile", "landmark", "value").collect()} for t in (found, again))
    assert one == pytest.approx(two) and one
    assert near_pairs(mobile.select(F.col("mobile").alias("id_a"), "x", "y", "z"), static.select(F.col("static_idx").alias("id_b"), "x", "y", "z"), wide, 0.0).count() == 0
    assert clustering.CHUNK > 0
