import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.errors import InsufficientSitesError, MergedSitesTooDistantError, MergeSitesError, MultipleOccupancyError, ZeroLandmarkError
from kinetrail.operators import clustering, descriptors, graph, landmarks, merging, pathways, positions, series
from kinetrail.operators.jump_statistics import analyse_jumps
from kinetrail.operators.trajectory import SiteTrajectory, from_matrix
from kinetrail.sources.archive import read_archive, write_archive
from kinetrail.sources.tables import load_network, load_trajectory, network_from_rows, save_network, save_trajectory
from kinetrail.sources.voronoi_text import parse_cell, parse_nodes, structure_text

CELL = [[10, 0, 0], [0, 10, 0], [0, 0, 10]]


@pytest.fixture()
def network(spark):
    corners = [(x, y, z) for x in (0.0, 5.0) for y in (0.0, 5.0) for z in (0.0, 5.0)]
    atoms = [(i, 8, "O", 16.0, *p, True, False) for i, p in enumerate(corners)]
    atoms += [(8, 3, "Li", 7.0, 2.5, 2.5, 2.5, False, True), (9, 3, "Li", 7.0, 7.5, 7.5, 7.5, False, True)]
    sites = [(0, 2.5, 2.5, 2.5, [0, 1, 2, 3, 4, 5, 6, 7], 0), (1, 7.5, 2.5, 2.5, [0, 1, 2, 3], 1), (2, 2.5, 7.5, 2.5, [4, 5, 6, 7], 1), (3, 7.5, 7.5, 7.5, [0, 7], 0)]
    return network_from_rows(spark, atoms, CELL, sites)


@pytest.fixture()
def st(spark, network):
    wide = spark.createDataFrame([(0, [0, 3]), (1, [1, 3]), (2, [-1, 3]), (3, [0, 2]), (4, [1, 3])], "frame int, sites array<int>")
    return SiteTrajectory(network, from_matrix(wide))


def frames_of(spark, n_frames=5):
    draw = np.random.default_rng(5)
    rows = []
    for f in range(n_frames):
        for i in range(8):
            rows.append((f, i, *map(float, ((i // 4) * 5, (i // 2 % 2) * 5, (i % 2) * 5))))
        for i, c in ((8, 2.5), (9, 7.5)):
            rows.append((f, i, *(c + draw.uniform(-0.2, 0.2, 3)).tolist()))
    return spark.createDataFrame(rows, "frame long, atom_id int, x double, y double, z double")


def test_attributes_and_their_lineage(spark, network):
    values = spark.createDataFrame([(0, 1.5), (2, 2.5)], "site_id int, depth double")
    n = network.add_site_attribute("depth", values, computed=False).add_site_attribute("height", values.withColumnRenamed("depth", "height"))
    assert n.site_attributes == ["depth", "height"] and n.copy(False).site_attributes == ["depth"]
    assert [r.depth for r in n.depth.orderBy("site_id").collect()] == [1.5, None, 2.5, None]
    for bad in ("depth", "cx", "n_sites", "2x", "a b"):
        with pytest.raises((KeyError, ValueError)):
            n.add_site_attribute(bad, values)
    assert n.remove_attribute("depth").site_attributes == ["height"]
    with pytest.raises(AttributeError):
        n.remove_attribute("nothing")
    with pytest.raises(AttributeError):
        n.nothing  # noqa: B018


def test_subsets_and_types(network):
    odd = network.of_type(1)
    assert [(r.site_id, r.cx) for r in odd.sites.orderBy("site_id").collect()] == [(0, 7.5), (1, 2.5)]
    with pytest.raises(ValueError):
        network.of_type(7)
    assert (network.n_sites, network.n_types, network.n_static, network.n_mobile, network.n_total) == (4, 2, 8, 2, 10)
    assert network.structure_with_sites().where("is_site").select("symbol").distinct().first().symbol == "Li"
    moved = network.with_centers(network.sites.withColumn("cx", F.col("cx") + 1))
    assert moved.sites.columns == ["site_id", "cx", "cy", "cz"]


def test_trajectory_checks(spark, st):
    assert st.n_frames == 5 and [r.site for r in st.particle(0).collect()] == [0, 1, -1, 0, 1]
    cut = st.slice(1, 5, 2)
    assert [(r.frame, r.site) for r in cut.particle(0).collect()] == [(0, 1), (1, 0)]
    assert st.check_multiple_occupancy() == (0, 1.0)
    both = SiteTrajectory(st.network, spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "frame long, mobile long, site int"))
    with pytest.raises(MultipleOccupancyError) as e:
        both.check_multiple_occupancy()
    assert (e.value.mobile, e.value.site, e.value.frame) == ([0, 1], 1, 0)
    with pytest.raises(ValueError):
        st.with_frames(frames_of(spark, 4))
    assert st.with_frames(frames_of(spark)).positions_for_site(3).count() == 4
    occupancy = {r.site_id: r.occupancy for r in st.with_occupancies().network.occupancy.collect()}
    assert occupancy == {0: 0.4, 1: 0.4, 2: 0.2, 3: 0.8}


def test_unoccupied_sites_go(spark, st):
    fewer = SiteTrajectory(st.network, st.assign.where("mobile = 1"))
    out = fewer.remove_unoccupied()
    assert out.network.n_sites == 2 and [r.site for r in out.particle(1).collect()] == [1, 1, 1, 0, 1]
    with pytest.raises(InsufficientSitesError):
        SiteTrajectory(st.network, st.assign.where("mobile = 1 and site = 3")).remove_unoccupied()


def test_jump_analysis_on_a_network(st):
    n = analyse_jumps(st).network
    edge = n.get_edge(0, 1).first()
    assert (edge.n_ij, edge.jump_lag) == (2.0, 1.5)
    assert n.get_edge(2, 0).first().jump_lag == float("inf")
    assert n.get_site(3).first().total_corrected_residences == 4
    assert analyse_jumps(analyse_jumps(st)).network.site_attributes == n.site_attributes


def test_saved_tables_and_archives_come_back(spark, st, tmp_path):
    full = analyse_jumps(st.with_frames(frames_of(spark)))
    save_trajectory(full, f"{tmp_path}/st")
    back = load_trajectory(spark, f"{tmp_path}/st")
    assert back.assign.count() == 10 and back.frames.count() == 50 and back.network.computed == full.network.computed
    save_network(full.network, f"{tmp_path}/n")
    assert load_network(spark, f"{tmp_path}/n").cell == full.network.cell
    write_archive(full.network, f"{tmp_path}/a.tar.gz")
    again = read_archive(spark, f"{tmp_path}/a.tar.gz")
    key = lambda n: sorted((r.src, r.dst, r.n_ij) for r in n.edges.where("n_ij > 0").collect())
    assert key(again) == key(full.network)
    assert [r.vertices for r in again.sites.orderBy("site_id").collect()] == [r.vertices for r in full.network.sites.orderBy("site_id").collect()]


def test_text_formats(spark, network):
    text = "va= 10 0 0\nvb= 0 9 0\nvc= 0 0 8\nVertex table:\n0 1.0 2.0 3.0 0.5 1 2 3\n1 4 5 6 0.7 4\n\nEdge table:\n0 -> 1 0.25 0 0 0\n"
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")
    nodes, edges = parse_nodes(lines)
    assert [tuple(r) for r in nodes.orderBy("node").collect()] == [(0, 1.0, 2.0, 3.0, 0.5, [1, 2, 3]), (1, 4.0, 5.0, 6.0, 0.7, [4])]
    assert [tuple(r) for r in edges.collect()] == [(0, 1, 0.25)]
    assert parse_cell(lines).rows[2] == (0.0, 0.0, 8.0)
    assert structure_text(network.atoms, network.cell).count() == 12


def test_components_and_markov_clusters(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (3, 4)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(6)], "site_id int")
    weak = {r.site_id: r.component for r in graph.weak_components(edges, nodes).collect()}
    assert weak == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    strong = {r.site_id: r.component for r in graph.strong_components(edges, nodes).collect()}
    assert strong == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("seed", [1])
def test_strong_components_by_tables(spark, monkeypatch, seed):
    draw = np.random.default_rng(seed)
    edges = spark.createDataFrame([tuple(map(int, draw.integers(0, 18, 2))) for _ in range(22)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(20)], "site_id int")
    want = {tuple(r) for r in graph.strong_components(edges, nodes).collect()}
    monkeypatch.setattr(graph, "DRIVER_EDGES", 3)
    assert {tuple(r) for r in graph.strong_components(edges, nodes).collect()} == want and len(want) == 20


def flow_clusters(m, expansion, inflation):
    """Markov clusters of a dense matrix, column after column."""
    n = len(m)
    flow = [{i: m[i, j] / m[:, j].sum() for i in range(n) if m[i, j]} for j in range(n)]
    while True:
        grown = flow
        for _ in range(expansion - 1):
            grown = [{i: sum(w * flow[k].get(i, 0.0) for k, w in column.items()) for i in {i for k in column for i in flow[k]}} for column in grown]
        then = []
        for column in grown:
            total = sum(v**inflation for v in column.values())
            share = {i: v**inflation / total for i, v in column.items()}
            top = min(share, key=lambda i: (-share[i], i))
            then.append({i: v for i, v in share.items() if v >= 1e-5 or i == top})
        if all(a.keys() == b.keys() and all(abs(a[i] - b[i]) <= 1e-8 + 1e-5 * b[i] for i in a) for a, b in zip(then, flow)):
            return sorted({tuple(j for j in range(n) if i in then[j]) for i in range(n) if i in then[i]})
        flow = then


@pytest.mark.parametrize("n, expansion, inflation", [(4, 2, 2), (9, 2, 4), (9, 3, 1.6)])
def test_markov_clusters_equal_a_loop(spark, n, expansion, inflation):
    draw = np.random.default_rng(n + expansion)
    m = np.kron(np.eye(2), np.ones((2, 2))) if n == 4 else np.triu(draw.uniform(0, 1, (n, n)) * (draw.uniform(0, 1, (n, n)) < 0.35), 1)
    m = m + m.T * (n > 4) + np.eye(n)
    edges = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "src int, dst int, w double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "site_id int")
    found = {}
    for r in graph.markov_clusters(edges, nodes, "w", expansion=expansion, inflation=inflation).collect():
        found.setdefault(r.cluster, []).append(r.site_id)
    assert [tuple(sorted(found[k])) for k in range(len(found))] == flow_clusters(m, expansion, inflation)
    with pytest.raises(ValueError):
        graph.markov_clusters(edges.where("src <> 1 or dst <> 1"), nodes, "w")


def test_leaders_of_chunks_and_blocks_of_centers(spark, monkeypatch):
    draw = np.random.default_rng(3)
    tops = np.eye(6)
    rows = [(i * 3, (tops[i % 6] + draw.normal(0, 0.05, 6)).tolist()) for i in range(90)] + [(1, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)
    whole, n = clustering.leader_clusters(np.array([v for i, v in sorted(rows) if i != 1]), 0.8)
    one = clustering.fit_centers(df, 0.8).orderBy("center").collect()
    assert np.allclose([r.v for r in one], whole) and [r.n for r in one] == n.tolist()
    assert [r.v for r in clustering.fit_centers(df, 0.8, exact=True, chunk=5).orderBy("center").collect()] == [r.v for r in one]
    monkeypatch.setattr(clustering, "FAN", 3)
    for parts in (2, 7):
        many = clustering.fit_centers(df.repartition(parts), 0.8, chunk=20).orderBy("center").collect()
        assert len(many) == 6 and sum(r.n for r in many) == 90
        assert all((np.array(r.v) @ np.array(o.v)) / np.linalg.norm(r.v) / np.linalg.norm(o.v) > 0.99 for r, o in zip(many, one))
    centers = spark.createDataFrame([(r.center, r.v) for r in one], "center int, v array<double>")
    want = {tuple(r) for r in clustering.predict(df, centers, 0.5).collect()}
    monkeypatch.setattr(clustering, "BROADCAST_VALUES", 13)
    assert {tuple(r) for r in clustering.predict(df, centers, 0.5).collect()} == want and len(want) == 91


def test_ranks_within_sites(spark):
    rows = [(f, m, (f * m) % 3) for f in range(12) for m in range(7)]
    got = {(r.frame, r.mobile): r.i for r in series.site_ranks(spark.createDataFrame(rows, "frame long, mobile long, site int"), "i").collect()}
    for site in range(3):
        for i, (f, m, _) in enumerate(sorted(x for x in rows if x[2] == site)):
            assert got[f, m] == i


def test_long_chains_are_one_component(spark):
    edges = spark.range(200).selectExpr("cast(id as int) as src", "cast(id + 1 as int) as dst")
    nodes = spark.range(201).selectExpr("cast(id as int) as site_id")
    assert graph.weak_components(edges, nodes).select("component").distinct().count() == 1


def test_percolating_pathways(spark, network):
    sites = spark.createDataFrame([(0, 1.0, 5.0, 5.0), (1, 4.0, 5.0, 5.0), (2, 7.0, 5.0, 5.0), (3, 5.0, 1.0, 1.0), (4, 5.0, 2.0, 1.0)], "site_id int, cx double, cy double, cz double")
    counts = spark.createDataFrame([(0, 1, 3.0), (1, 2, 3.0), (2, 0, 3.0), (3, 4, 3.0)], "src int, dst int, n_ij double")
    found, ways = pathways.periodic_pathways(counts, sites, network.cell)
    assert {r.site_id: r.pathway for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1}
    assert [tuple(r) for r in ways.collect()] == [(0, True, False, False)]
    plain = {r.site_id: r.pathway for r in pathways.site_pathways(counts, sites, 1, 2).collect()}
    assert plain == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def test_merging_checks(spark, st):
    class Fixed(merging.MergeSites):
        def groups(self, st):
            return spark.createDataFrame(self.rows, "site_id int, group int")

    merge = Fixed(check_types=False, set_merged_into=True)
    merge.rows = [(1, 0), (2, 0), (0, 1), (3, 2)]
    out = merge.run(st)
    assert [r.site for r in out.particle(1).collect()] == [2, 2, 2, 1, 2]
    assert {r.site_id: r.merged_into for r in merge.merged_from.merged_into.collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert out.network.sites.where("site_id = 1").first().vertices == list(range(8))
    merge.rows = [(1, 0), (2, 0), (1, 1)]
    with pytest.raises(MergeSitesError):
        merge.run(st)
    merge.rows = [(0, 0), (1, 0), (2, 0), (3, 0)]
    with pytest.raises(InsufficientSitesError):
        merge.run(st)
    near = Fixed(check_types=False, maximum_merge_distance=1.0)
    near.rows = [(1, 0), (2, 0), (0, 1)]
    with pytest.raises(MergedSitesTooDistantError):
        near.run(st)
    typed = Fixed()
    typed.rows = [(0, 0), (1, 0), (2, 1)]
    with pytest.raises(MergeSitesError):
        typed.run(st)


def test_leader_clustering_is_a_loop():
    draw = np.random.default_rng(8)
    base = np.eye(4)
    x = np.vstack([base[i % 4] + draw.normal(0, 0.05, 4) for i in range(40)])
    centers, n = clustering.leader_clusters(x, 0.9)
    assert len(centers) == 4 and n.tolist() == [10.0] * 4


def test_prediction_ties_and_zero_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [-2.0, 0.0])], "vec_id long, v array<double>")
    centers = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "center int, v array<double>")
    found = {r.vec_id: (r.label, round(r.confidence, 6)) for r in clustering.predict(vectors, centers, 0.7).collect()}
    assert found == {0: (0, 1.0), 1: (-1, 0.0), 2: (0, 0.707107), 3: (0, 1.0)}
    assert [r.label for r in clustering.predict(vectors, centers, 0.8).orderBy("vec_id").collect()] == [0, -1, -1, 0]


@pytest.mark.parametrize("plugin", ["dotprod", "mcl"])
def test_landmark_pipeline(spark, network, plugin):
    two = network.subset(F.col("site_id").isin(0, 3)).sites.drop("vertices", "site_type")
    corners = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5, 6, 7]), (1, [0, 1, 2, 3, 4, 5, 6, 7])], "site_id int, vertices array<int>")
    from dataclasses import replace

    marked = replace(network, sites=two.join(corners, "site_id"))
    analysis = landmarks.LandmarkAnalysis(clustering=plugin, cutoff_midpoint=1.15, cutoff_steepness=15.0, clustering_parameters={} if plugin == "dotprod" else {"assignment_threshold": 0.1, "good_site_normed_threshold": 0.1, "good_site_projected_threshold": 0.1})
    if plugin == "dotprod":  # every corner is as far from both centers, so that one site is found for two particles
        with pytest.raises(InsufficientSitesError):
            analysis.run(marked, frames_of(spark))
    with pytest.raises(ValueError):
        landmarks.LandmarkAnalysis().run(replace(network, sites=None), frames_of(spark))


def test_zero_landmarks_raise(spark, network):
    tiny = landmarks.LandmarkAnalysis(cutoff_midpoint=0.01, cutoff_steepness=1000.0)
    with pytest.raises(ZeroLandmarkError):
        tiny.run(network, frames_of(spark))


def test_landmark_values_equal_the_formula(spark):
    from kinetrail.functions.geometry import Cell

    cell = Cell.of(CELL)
    draw = np.random.default_rng(9)
    static, mobile = draw.uniform(0, 10, (6, 3)), draw.uniform(0, 10, (5, 3))
    sites = [(0, 1.0, 1.0, 1.0, [0, 1, 2]), (1, 6.0, 6.0, 6.0, [2, 3, 4, 5])]
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(static)], "static_idx int, x double, y double, z double")
    m = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(mobile)], "frame long, mobile long, x double, y double, z double")
    lm = spark.createDataFrame(sites, "site_id int, cx double, cy double, cz double, vertices array<int>")
    found = {(r.mobile, r.landmark): r.value for r in landmarks.landmark_vectors(m, s, landmarks.reference_distances(lm, s, cell), cell, 1.5, 3.0).collect()}
    cut = landmarks.cutoff_point(1.5, 3.0)
    for i, p in enumerate(mobile):
        for k, *c, vertices in sites:
            r = np.array([cell.distances_array(p, static[v][None])[0] / cell.distances_array(np.array(c), static[v][None])[0] for v in vertices])
            want = 0.0 if (r > cut).any() else np.prod(1 / (1 + np.exp(3 * (r - 1.5)))) ** (1 / len(r))
            assert found.get((i, k), 0.0) == pytest.approx(want)


def test_positions_operators(spark, st):
    full = st.with_frames(frames_of(spark))
    at = full.positions()
    out = positions.clamped_trajectory(full, pass_through=True)
    assert out.count() == 50
    r = {(r.frame, r.atom_id): (r.x, r.y, r.z) for r in out.collect()}
    assert r[0, 8] == pytest.approx((2.5, 2.5, 2.5)) and r[1, 8] == pytest.approx((-2.5, 2.5, 2.5)) or r[1, 8] == pytest.approx((7.5, 2.5, 2.5))
    with pytest.raises(ValueError):
        positions.averages_per_site(at, full.network.sites, full.network.cell, 4).count()
    some = positions.averages_per_site(at, full.network.sites, full.network.cell, 2, error_on_insufficient=False, weighted=False)
    assert {(x.site, x["count"]) for x in some.groupBy("site").count().collect()} == {(0, 2), (1, 2), (2, 1), (3, 2)}
    around = positions.points_around_sites(full.network, 3, 0.1, seed=1)
    assert around.n_sites == 12 and around.sites.agg(F.max("cx")).first()[0] < 10
    v = {x.site_id: x.volume for x in positions.site_volumes(full.network, error_on_insufficient=False).collect()}
    assert v[0] == pytest.approx(125.0) and v[3] == 0.0
    made = positions.voronoi_sites(full.network)
    assert made.n_sites == 8


def test_accessible_volume_of_a_cube(spark):
    draw = np.random.default_rng(2)
    cube = [(i, j, k) for i in (4.0, 6.0) for j in (4.0, 6.0) for k in (4.0, 6.0)] + draw.uniform(4.1, 5.9, (60, 3)).tolist()
    at = spark.createDataFrame([(f, 0, 7, *map(float, p)) for f, p in enumerate(cube)], "frame long, mobile long, site int, x double, y double, z double")
    from kinetrail.functions.geometry import Cell

    r = positions.accessible_volumes(at, Cell.of(CELL)).first()
    assert (r.site, r.volume, r.area) == (7, pytest.approx(8.0), pytest.approx(24.0))


def test_vibration_of_a_sine(spark):
    n = 64
    rows = [(f, 0, float(np.cumsum([2 + np.cos(2 * np.pi * 8 * t / (n - 1)) for t in range(f)])[-1]) if f else 0.0, 0.0, 0.0) for f in range(n)]
    frames = spark.createDataFrame(rows, "frame long, atom_id int, x double, y double, z double")
    assert positions.vibrational_frequencies(frames).first().frequency == pytest.approx(8 / 63, rel=1e-6)


def test_descriptors_and_types(spark, network, st):
    d = descriptors.StructureDescriptor()
    at = d.of_centers(network)
    assert at.count() == 4 and len(at.first().v) == 13
    full = st.with_frames(frames_of(spark))
    assert d.averaged(full, averaging=2).groupBy("site_id").count().count() == 4
    assert descriptors.atomic_numbers(["Li", 8]) == [3, 8]
    with pytest.raises(ValueError):
        descriptors.atomic_numbers(["Xx"])
    draw = np.random.default_rng(6)
    rows = [(i, i % 6, (np.array([5.0, 0, 0]) * (i % 6 < 3) + draw.normal(0, 0.05, 3)).tolist()) for i in range(60)]
    types, labels = descriptors.site_types(spark.createDataFrame(rows, "sample_id long, site_id int, v array<double>"), n_types_max=6)
    t = {r.site_id: r.site_type for r in types.collect()}
    assert len({t[0], t[1], t[2]}) == 1 and len({t[3], t[4], t[5]}) == 1 and t[0] != t[3]
    n = {r.site_id: (r.coordination_number, r.environment) for r in descriptors.coordination_environments(network, 4.5).collect()}
    assert n[0] == (8, "CN:8")
