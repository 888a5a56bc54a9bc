"""Positions to sites, end to end, in a lattice with known cages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.errors import StaticLatticeError
from kinetrail.operators import plots
from kinetrail.operators.jump_statistics import analyse_jumps
from kinetrail.operators.landmarks import LandmarkAnalysis
from kinetrail.operators.positions import voronoi_sites
from kinetrail.sources.tables import network_from_rows

SPACING, SIDE = 4.0, 12.0
LATTICE = [(x, y, z) for x in (0.0, 4.0, 8.0) for y in (0.0, 4.0, 8.0) for z in (0.0, 4.0, 8.0)]
CAGES = {"a": (2.0, 2.0, 2.0), "b": (6.0, 2.0, 2.0), "c": (10.0, 10.0, 10.0)}


@pytest.fixture(scope="module")
def network(spark):
    atoms = [(i, 8, "O", 16.0, *p, True, False) for i, p in enumerate(LATTICE)]
    atoms += [(27, 3, "Li", 7.0, *CAGES["a"], False, True), (28, 3, "Li", 7.0, *CAGES["c"], False, True)]
    return voronoi_sites(network_from_rows(spark, atoms, np.diag([SIDE] * 3)))


def frames(spark, n=24, swap=False, shift=0.0):
    draw = np.random.default_rng(4)
    rows = []
    for f in range(n):
        for i, p in enumerate(LATTICE):
            j = {0: 1, 1: 0}.get(i, i) if swap and f >= n // 2 else i
            rows.append((f, i, *(np.array(LATTICE[j]) + draw.normal(0, 0.05, 3) + (shift if i == 5 else 0)).tolist()))
        rows.append((f, 27, *(np.array(CAGES["a" if f < 10 else "b"]) + draw.normal(0, 0.1, 3)).tolist()))
        rows.append((f, 28, *(np.array(CAGES["c"]) + draw.normal(0, 0.1, 3) + SIDE * (f % 2)).tolist()))
    return spark.createDataFrame(rows, "frame long, atom_id int, x double, y double, z double")


def test_cages_are_the_voronoi_nodes(network):
    assert network.n_sites == 27
    assert {len(r.vertices) for r in network.sites.collect()} == {8}


@pytest.mark.parametrize("clustering,centers", [("dotprod", "real-unweighted"), ("dotprod", "real-weighted"), ("dotprod", "representative-landmark"), ("mcl", "real-unweighted")])
def test_sites_and_jumps(spark, network, clustering, centers):
    st = LandmarkAnalysis(clustering=clustering, site_centers=centers).run(network, frames(spark))
    found = {r.site_id: (r.cx, r.cy, r.cz) for r in st.network.sites.collect()}
    assert len(found) == 3
    cell = network.cell
    name = {k: min(CAGES, key=lambda c: cell.distances_array(np.array(p), np.array(CAGES[c])[None])[0]) for k, p in found.items()}
    assert sorted(name.values()) == ["a", "b", "c"]
    assert all(cell.distances_array(np.array(p), np.array(CAGES[name[k]])[None])[0] < 0.2 for k, p in found.items())
    path = [name.get(r.site, "?") for r in st.particle(0).collect()]
    assert path == ["a"] * 10 + ["b"] * 14
    assert [name[r.site] for r in st.particle(1).collect()] == ["c"] * 24
    edges = {(name[r.src], name[r.dst]): r.n_ij for r in analyse_jumps(st).network.edges.where("n_ij > 0").collect()}
    assert edges == {("a", "a"): 10.0, ("a", "b"): 1.0, ("b", "b"): 13.0, ("c", "c"): 24.0}


def test_swapped_lattice_atoms(spark, network):
    st = LandmarkAnalysis(dynamic_lattice_mapping=True).run(network, frames(spark, swap=True))
    assert st.network.n_sites == 3
    with pytest.raises(StaticLatticeError):
        LandmarkAnalysis().run(network, frames(spark, shift=1.5))


def test_edges_of_a_plot(spark, network):
    sites = spark.createDataFrame([(0, 1.0, 6.0, 6.0), (1, 5.0, 6.0, 6.0), (2, 11.0, 6.0, 6.0)], "site_id int, cx double, cy double, cz double")
    edges = spark.createDataFrame([(0, 1, 4.0), (1, 0, 2.0), (0, 2, 6.0), (2, 2, 9.0), (1, 2, 0.5)], "src int, dst int, n double")
    found = {(r.src, r.dst): (r.x2, r.value, r.outside) for r in plots.edge_segments(edges, "n", sites, network.cell, 1.0).collect()}
    assert found == {(0, 1): (5.0, 3.0, False), (0, 2): (-1.0, 3.0, True)}
    scaled = [r.n for r in plots.normalised(edges, "n").orderBy("n").collect()]
    assert scaled[0] == 0 and scaled[-1] == 1
    assert plots.normalised(edges.withColumn("n", F.lit(2.0)), "n").first().n is None
