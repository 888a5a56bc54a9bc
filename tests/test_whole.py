"""Queries and operators do the whole job: all rows, all components, all neighbours."""

from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from kinetrail.functions.hulls import voronoi_nodes
from kinetrail.operators import descriptors, graph
from kinetrail.plans import catalogue

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def same_as_whole_sql(spark, name):
    """The query's rows, after comparing them with its SQL."""
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    want = con.sql(catalogue.ORACLES[name]).df()
    key = list(want.columns)
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()[key]
    want, got = (d.sort_values(key).reset_index(drop=True).astype("float64") for d in (want, got))
    assert got.shape == want.shape
    assert np.allclose(got, want, atol=2e-6)
    return got


@needs_data
@pytest.mark.parametrize("name, rows", [("landmark_corr", 64 * 64), ("representative_vectors", 64 * 10)])
def test_all_components(spark, name, rows):
    assert len(same_as_whole_sql(spark, name)) == rows


@needs_data
@pytest.mark.parametrize("name", ["landmark_vectors", "landmark_zero_check"])
def test_all_frames(spark, name):
    assert same_as_whole_sql(spark, name)["frame"].nunique() > 5


@needs_data
def test_all_particles(spark):
    same_as_whole_sql(spark, "static_lattice_check")
    assert same_as_whole_sql(spark, "remove_unoccupied")["mobile"].nunique() == 150


def peaks_of(v, quantile):
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    pairs = np.sort(d[np.triu_indices(len(v), 1)])
    cut = max(pairs[int(np.ceil(quantile * len(pairs))) - 1], 1e-12)
    density = np.exp(-((d / cut) ** 2)).sum(1) - 1
    out = {}
    for i in range(len(v)):
        denser = [j for j in range(len(v)) if density[j] > density[i]]
        parent = min(denser, key=lambda j: (d[i, j], j)) if denser else None
        out[i] = density[i], d[i].max() if parent is None else d[i, parent], parent
    return out


@pytest.mark.parametrize("n, quantile", [(2, 0.02), (150, 0.02), (150, 0.5)])
def test_density_peaks_equal_all_pairs(spark, n, quantile):
    v = np.random.default_rng(3).normal(0, 1, (n, 3))
    found = descriptors.density_peaks(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "sample_id long, v array<double>").repartition(3), quantile).collect()
    want = peaks_of(v, quantile)
    assert len(found) == n
    for r in found:
        if n > 2:  # of two samples the densities are equal
            assert (r.density, r.delta, r.parent) == (pytest.approx(want[r.sample_id][0]), pytest.approx(want[r.sample_id][1]), want[r.sample_id][2])
    assert sum(r.parent is None for r in found) == 1


def test_density_peaks_of_copies(spark):
    rows = spark.createDataFrame([(i, [float(i >= 70)]) for i in range(140)], "sample_id long, v array<double>")
    found = {r.sample_id: r for r in descriptors.density_peaks(rows).collect()}
    assert len(found) == 140 and found[0].parent is None and found[0].delta == 1 and found[5].parent == 0 and found[5].delta == 0
    one = descriptors.density_peaks(rows.where("sample_id = 3")).collect()
    assert [(r.sample_id, r.density, r.parent) for r in one] == [(3, 0.0, None)]


@needs_data
def test_pca_types_reads_every_vector(spark, monkeypatch):
    seen = []
    real = descriptors.site_types
    monkeypatch.setattr(descriptors, "site_types", lambda rows, **k: seen.append(rows.count()) or real(rows, **k))
    catalogue.pca_types(spark, str(DATA)).collect()
    assert seen == [spark.read.parquet(f"{DATA}/embeddings.parquet").count()]


def nodes_of_all_triples(points, matrix, w, reach):
    """Power centers of an atom and any three images that no image is nearer to."""
    shifts = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]) @ matrix
    every, owner = (points[None] + shifts[:, None]).reshape(-1, 3), np.tile(np.arange(len(points)), 27)
    out = {}
    for a, p in enumerate(points):
        gap = np.linalg.norm(every - p, axis=1)
        near = np.flatnonzero((gap > 1e-12) & (gap <= reach))
        triples = np.array(list(combinations(near, 3)))
        m = 2 * (every[triples] - p)
        b = (every[triples] ** 2).sum(2) - (p**2).sum() - w[owner[triples]] + w[a]
        solid = np.abs(np.linalg.det(m)) > 1e-9
        at = np.linalg.solve(m[solid], b[solid][..., None])[..., 0]
        mine = ((at - p) ** 2).sum(1) - w[a]
        for lo in range(0, len(at), 20_000):
            c = at[lo : lo + 20_000]
            power = (c**2).sum(1)[:, None] - 2 * c @ every.T + (every**2).sum(1) - w[owner]
            for k in np.flatnonzero(power.min(1) >= mine[lo : lo + len(c)] - 1e-7):
                f = c[k] @ np.linalg.inv(matrix)
                key = tuple(np.round(f - np.floor(f + 1e-6), 4) % 1.0)
                out.setdefault(key, set()).update(owner[np.abs(power[k] - mine[lo + k]) <= 1e-6].tolist())
    return out


def same_nodes(points, matrix, w, reach=np.inf):
    nodes, atoms = voronoi_nodes(points, matrix, w)
    f = nodes @ np.linalg.inv(matrix)
    got = {tuple(np.round(x - np.floor(x + 1e-6), 4) % 1.0): set(a) for x, a in zip(f, atoms)}
    want = nodes_of_all_triples(points, matrix, w, reach)
    assert len(got) == len(nodes)
    for x, a in want.items():
        assert any(np.abs((np.array(x) - y + 0.5) % 1 - 0.5).max() < 3e-4 and a == b for y, b in got.items())
    assert len(got) == len(want)
    return got


@pytest.mark.parametrize("weighted", [False, True])
def test_voronoi_nodes_of_few_points(weighted):
    draw = np.random.default_rng(4)
    matrix = np.array([[10.0, 0, 0], [2, 9, 0], [1, 1.5, 8]])
    same_nodes(draw.uniform(0, 1, (3, 3)) @ matrix, matrix, draw.uniform(0, 4, 3) if weighted else np.zeros(3))


def test_voronoi_nodes_around_a_wide_void():
    """Two dense clumps: each atom's forty nearest are in its own clump."""
    draw = np.random.default_rng(5)
    matrix = np.eye(3) * 20.0
    points = np.vstack([c + draw.uniform(-0.7, 0.7, (45, 3)) for c in (np.full(3, 5.0), np.array([14.0, 15, 13]))])
    nodes, atoms = voronoi_nodes(points, matrix)
    shifts = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]) @ matrix
    every = (points[None] + shifts[:, None]).reshape(-1, 3)
    owner = np.tile(np.arange(90), 27)
    assert any(len({k // 45 for k in a}) == 2 for a in atoms)
    # The simplices of the nodes fill the cell; one lost node leaves a hole.
    total = 0.0
    for x, a in zip(nodes, atoms):
        images = every[np.isin(owner, a)]
        corners = images[np.argsort(np.linalg.norm(images - x, axis=1))[:4]]
        total += abs(np.linalg.det(corners[1:] - corners[0])) / 6
    assert total == pytest.approx(20.0**3, rel=1e-6)


def test_dense_matrix_raises_beyond_its_edges(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (2, 0, 4.0)], "src int, dst int, n_ij double")
    monkeypatch.setattr(graph, "DRIVER_EDGES", 3)
    assert graph.dense_matrix(edges, "n_ij", 3).sum() == 9
    monkeypatch.setattr(graph, "DRIVER_EDGES", 2)
    with pytest.raises(ValueError):
        graph.dense_matrix(edges, "n_ij", 3)


def test_sites_of_flat_vertices_have_no_volume_but_an_area(spark):
    from kinetrail.functions.geometry import Cell
    from kinetrail.operators.network import SiteNetwork
    from kinetrail.operators.positions import site_volumes

    at = [(1.0, 1.0, 2.0), (3.0, 1.0, 2.0), (1.0, 3.0, 2.0), (3.0, 3.0, 2.0), (1.0, 1.0, 4.0)]
    atoms = spark.createDataFrame([(i, 8, "O", 16.0, *p, True, False, i, None) for i, p in enumerate(at)], "atom_id int, atomic_number int, symbol string, mass double, x double, y double, z double, is_static boolean, is_mobile boolean, static_idx int, mobile_idx int")
    sites = spark.createDataFrame([(0, 2.0, 2.0, 2.0, [0, 1, 2, 3]), (1, 2.0, 2.0, 2.0, [0, 1, 2, 2]), (2, 2.0, 2.0, 2.0, [4, 4, 4, 4]), (3, 2.0, 2.0, 2.0, [0, 1, 2, 4])], "site_id int, cx double, cy double, cz double, vertices array<int>")
    found = {r.site_id: (r.volume, r.area) for r in site_volumes(SiteNetwork(atoms, Cell.of(np.eye(3) * 10), sites)).collect()}
    assert found[0] == pytest.approx((0.0, 8.0)) and found[1] == pytest.approx((0.0, 4.0)) and found[2] == (0.0, 0.0)
    assert found[3] == pytest.approx((4 / 3, 6 + 2 * 3**0.5))


def test_angular_moments_need_no_pairs():
    import tracemalloc

    draw = np.random.default_rng(6)
    d, w = draw.normal(0, 1, (60, 3)), draw.uniform(0, 1, 60)
    d[0] = (0, 0, -2)  # a pole
    cos = np.clip(d @ d.T / np.linalg.norm(d, axis=1) / np.linalg.norm(d, axis=1)[:, None], -1, 1)
    want = [(np.polynomial.legendre.legval(cos, np.eye(7)[n]) * w * w[:, None]).sum() for n in range(7)]
    assert descriptors.angular_moments(d, w, 6) == pytest.approx(want)
    from kinetrail.functions.geometry import Cell

    dense = draw.uniform(0, 10, (40_000, 3))  # 4,500 neighbours: 20 million pairs, 160 MB an array
    tracemalloc.start()
    found = descriptors.radial_backend()(dense, np.full(40_000, 8), [8], Cell.of(np.eye(3) * 10), np.full((1, 3), 5.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (1, 13) and found[0, 6] == pytest.approx((0.5 * (np.cos(np.pi * np.linalg.norm(dense - 5, axis=1)[np.linalg.norm(dense - 5, axis=1) < 3] / 3) + 1)).sum() ** 2)
    assert peak < 150e6


def test_descriptors_look_at_the_atoms_around_a_point():
    import tracemalloc

    from kinetrail.functions.geometry import Cell

    cell, draw = Cell.of([[10, 0, 0], [2, 9, 0], [1, 1.5, 8]]), np.random.default_rng(7)
    atoms, kinds, points = draw.uniform(-20, 20, (300, 3)), draw.integers(7, 9, 300), draw.uniform(-20, 20, (40, 3))
    found = descriptors.radial_backend()(atoms, kinds, [7, 8], cell, points)
    shifts = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]) @ cell.matrix
    for p, v in zip(cell.wrap_array(points), found):
        for e, z in enumerate((7, 8)):
            r = np.linalg.norm((cell.wrap_array(atoms[kinds == z])[:, None] + shifts - p).reshape(-1, 3), axis=1)
            r = r[r < 3]
            shells = np.exp(-0.5 * ((r[:, None] - np.linspace(0, 3, 6)) / 0.4) ** 2) * 0.5 * (np.cos(np.pi * r / 3) + 1)[:, None]
            assert v[13 * e : 13 * e + 6] == pytest.approx(shells.sum(0))
    tracemalloc.start()
    descriptors.radial_backend()(draw.uniform(0, 100, (200_000, 3)), np.full(200_000, 8), [8], Cell.of(np.eye(3) * 100), np.full((1, 3), 50.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all images of all atoms are 130 MB


def test_descriptors_without_atoms():
    from kinetrail.functions.geometry import Cell

    assert not descriptors.radial_backend()(np.zeros((0, 3)), np.zeros(0, int), [8], Cell.of(np.eye(3) * 10), np.zeros((2, 3))).any()


def test_density_peaks_by_tiles_bins_and_weights(spark, monkeypatch):
    """Several tiles, a quantile found through bins and many copies give what all pairs give."""
    monkeypatch.setattr(descriptors, "_TILE", 16)
    monkeypatch.setattr(descriptors, "_BINS", 32)
    monkeypatch.setattr(descriptors, "_VALUES", 40)
    draw = np.random.default_rng(9)
    different = draw.normal(3, 1, (90, 4))
    v = np.vstack([different, different[draw.integers(0, 30, 60)]])
    for quantile in (0.003, 0.02, 0.6, 1.0):
        found = descriptors.density_peaks(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "sample_id long, v array<double>").repartition(3), quantile).collect()
        want = peaks_of(v, quantile)
        assert len(found) == 150 and sum(r.parent is None for r in found) == 1
        for r in found:
            density, delta, parent = want[r.sample_id]
            assert r.density == pytest.approx(density)
            if r.sample_id < 90:  # of copies the densities are equal but for rounding, so that the loop may take either
                assert quantile == 0.003 or r.delta == pytest.approx(delta, abs=1e-9) or delta == 0  # at 0.003 copies alone count: many ties
            else:
                assert r.delta == 0 and (v[r.parent] == v[r.sample_id]).all() and r.parent < 90


def test_density_peaks_compare_each_pair_of_different_vectors_once(monkeypatch, spark):
    """Work goes with the pairs of different vectors: 40 vectors with 25 copies each are one tile of 40, not 1,000 rows against 1,000."""
    monkeypatch.setattr(descriptors, "_TILE", 40)
    v = np.random.default_rng(10).normal(0, 1, (40, 3))
    rows = spark.createDataFrame([(k * 40 + i, v[i].tolist()) for k in range(25) for i in range(40)], "sample_id long, v array<double>")
    starts, real = [], type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, *a: starts.append(a) or real(self, *a))
    found = {r.sample_id: r for r in descriptors.density_peaks(rows).collect()}
    assert {a[:2] for a in starts} == {(0, 1)} and len(found) == 1000
    assert all(found[i].parent == i % 40 and found[i].delta == 0 for i in range(40, 1000))


@needs_data
def test_type_decisions_of_copies_compare_each_vector_once(spark, tmp_path, monkeypatch):
    """The decisions over three copies of every vector go through tiles of the different ones, and name the first copies."""
    from kinetrail.plans import structures

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    n = rows.count()
    rows.crossJoin(spark.range(3)).selectExpr("vec_id + 1000000 * id as vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    sizes = []
    monkeypatch.setattr(descriptors, "_TILE", n)
    kept = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, *a: sizes.append(a[:2]) or kept(self, *a))
    got = structures.type_decisions(spark, str(tmp_path)).collect()
    assert (0, 1) in sizes and len(got) == 30
    assert all(r.sample_id < 1000000 for r in got if r.decision > 0)


def _same_peaks(spark, v, quantile):
    found = descriptors.density_peaks(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "sample_id long, v array<double>").repartition(3), quantile).collect()
    want = peaks_of(v, quantile)
    assert len(found) == len(v)
    for r in found:
        density, delta, parent = want[r.sample_id]
        assert r.density == pytest.approx(density, rel=1e-9) and r.delta == pytest.approx(delta, rel=1e-9) and r.parent == parent


def test_density_peaks_rule_pairs_out_in_single_precision(spark, monkeypatch):
    """Of vectors far apart the quantile and the parents need no tile in double precision, and are those of all pairs."""

    def refused(*_):
        raise AssertionError("a tile in double precision")

    monkeypatch.setattr(descriptors, "_TILE", 64)
    monkeypatch.setattr(descriptors, "_VALUES", 2000)
    monkeypatch.setattr(descriptors, "_squares", refused)
    _same_peaks(spark, np.random.default_rng(11).normal(5, 1, (300, 6)), 0.05)


@pytest.mark.parametrize("quantile", [0.02, 0.5])
def test_density_peaks_of_vectors_that_single_precision_cannot_tell_apart(spark, monkeypatch, quantile):
    monkeypatch.setattr(descriptors, "_TILE", 64)
    monkeypatch.setattr(descriptors, "_VALUES", 2000)
    draw = np.random.default_rng(12)
    _same_peaks(spark, draw.normal(0, 1, (5, 3))[draw.integers(0, 5, 300)] + draw.normal(0, 1e-6, (300, 3)), quantile)


def test_single_precision_products_stay_within_their_error():
    draw = np.random.default_rng(13)
    for d in (1, 3, 58, 400):
        v = draw.normal(0, 1, (200, d))
        v = np.vstack([v, v + draw.normal(0, 1e-5, v.shape)])
        v *= 0.7 / np.sqrt((v * v).sum(1)).max()
        left, right = descriptors._sides(v, np.float32)
        assert abs(left @ right.T - ((v[:, None] - v) ** 2).sum(2)).max() <= descriptors._error(d, 0.7)
