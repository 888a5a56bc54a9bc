import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions.elbow import elbow_index
from kinetrail.functions.geometry import Cell, near_pairs, pairwise_distances, periodic_mean, point, recenter
from kinetrail.functions.hulls import convex_hull, flat_area, voronoi_nodes

CUBE = Cell.of([[10, 0, 0], [0, 10, 0], [0, 0, 10]])
SKEW = Cell.of([[10, 0, 0], [2, 9, 0], [1, 1.5, 8]])


def table(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, x double, y double, z double")


def test_minimum_image_of_the_next_cell(spark):
    df = table(spark, [(9, 0, 0)])
    m = df.select(CUBE.min_image((F.lit(1.0), F.lit(0.0), F.lit(0.0)), point("x", "y", "z")).alias("m")).first().m
    assert (m.x, m.y, m.z, m.code, m.distance) == (-1.0, 0.0, 0.0, 11, 2.0)


def test_periodic_mean_across_the_border(spark):
    df = table(spark, [(0.5, 5, 5), (9.5, 5, 5)]).withColumn("g", F.lit(0))
    x = periodic_mean(df, CUBE, ["g"], ["id"]).first().x
    assert min(x, 10 - x) == pytest.approx(0, abs=1e-9)


def test_wrap_and_distance_equal_numpy(spark):
    p = np.random.default_rng(1).uniform(-30, 30, (40, 3))
    got = table(spark, p).select(*SKEW.wrap(point("x", "y", "z"))).toPandas().to_numpy()
    assert np.allclose(got, SKEW.wrap_array(p))
    d = {(r.i, r.j): r.distance for r in pairwise_distances(table(spark, p[:12]), SKEW).collect()}
    for i in range(12):
        for j in range(i + 1, 12):
            assert d[i, j] == d[j, i] == pytest.approx(SKEW.distances_array(p[i], p[j][None])[0])
    assert all(d[i, i] == 0 for i in range(12))


@pytest.mark.parametrize("cutoff", [0.8, 2.5, 6.0])
def test_grid_join_finds_all_near_pairs(spark, cutoff):
    a, b = np.random.default_rng(2).uniform(0, 20, (2, 60, 3))
    found = near_pairs(table(spark, a).withColumnRenamed("id", "id_a"), table(spark, b).withColumnRenamed("id", "id_b"), CUBE, cutoff)
    want = {(i, j) for i in range(60) for j in range(60) if CUBE.distances_array(a[i], b[j][None])[0] <= cutoff}
    got = [(r.id_a, r.id_b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_recentring_pins_the_static_center_of_mass(spark):
    rows = [(f, a, float(a + f), float(a * f), 1.0) for f in range(3) for a in range(4)]
    frames = spark.createDataFrame(rows, "frame long, atom_id int, x double, y double, z double")
    atoms = spark.createDataFrame([(a, a < 2, 1.0 + a) for a in range(4)], "atom_id int, is_static boolean, mass double")
    out = recenter(frames, atoms, CUBE).join(atoms, "atom_id").where("is_static")
    for r in out.groupBy("frame").agg(*(F.sum(F.col("mass") * F.col(c)) / F.sum("mass") for c in "xyz")).collect():
        assert tuple(r)[1:] == pytest.approx((5, 5, 5))


def test_elbow(spark):
    curve = spark.createDataFrame([(float(v),) for v in (10, 9, 8, 1, 0.9, 0.8)], "v double")
    assert elbow_index(curve, "v").first().elbow == 3


def test_hull_of_a_cube_with_inner_points():
    cube = np.array([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)], float)
    inner = np.random.default_rng(3).uniform(0.1, 0.9, (50, 3))
    assert convex_hull(np.vstack([inner, cube])) == pytest.approx((1.0, 6.0))
    assert np.isnan(convex_hull(cube[cube[:, 0] == 0])[0])
    assert np.isnan(convex_hull(cube[:3])[0])


def test_voronoi_of_a_simple_cubic_lattice():
    nodes, atoms = voronoi_nodes(np.array([[0.0, 0, 0], [5, 0, 0], [0, 5, 0], [0, 0, 5], [5, 5, 0], [5, 0, 5], [0, 5, 5], [5, 5, 5]]), CUBE.matrix)
    assert len(nodes) == 8
    assert all(len(a) == 8 for a in atoms)
    assert np.allclose(sorted(map(tuple, np.round(nodes, 6)))[0], (2.5, 2.5, 2.5))


def test_thinned_points_have_the_same_hull():
    from kinetrail.operators.positions import hull_vertices

    p = np.random.default_rng(7).normal(0, 1, (9000, 3))
    kept = hull_vertices(p)
    assert len(kept) < 6000
    assert convex_hull(p[kept]) == pytest.approx(convex_hull(p))


@pytest.mark.parametrize("cell", [CUBE, SKEW])
def test_nearest_image_equals_min_image(spark, cell):
    from kinetrail.functions.geometry import nearest_image

    draw = np.random.default_rng(3)
    p = cell.wrap_array(draw.uniform(0, 20, (60, 3)))
    p[:20] = draw.integers(0, 10, (20, 3))  # whole numbers: ties in the cube
    rows = [(*map(float, a), *map(float, b)) for a in p[:30] for b in p[30:] if cell is SKEW] + [(*map(float, a), *map(float, b)) for a in p[:20] for b in p[:20] if cell is CUBE]
    df = spark.createDataFrame(rows, "ax double, ay double, az double, bx double, by double, bz double")
    ref, q = point("ax", "ay", "az"), point("bx", "by", "bz")
    for r in nearest_image(df.withColumn("m", cell.min_image(ref, q)), cell, ref, q).collect():
        assert r.m.code == r.image_code and r.m.distance == pytest.approx(r.image_distance) and (r.m.x, r.m.y, r.m.z) == pytest.approx((r.image_x, r.image_y, r.image_z))
    assert nearest_image(df, cell, ref, q).columns[-5:] == ["image_code", "image_x", "image_y", "image_z", "image_distance"]


def test_flat_area_counts_both_sides():
    square = np.array([[0, 0, 0], [2, 0, 0], [0, 2, 0], [2, 2, 0], [1, 0.5, 0]]) @ np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0] + 5
    assert flat_area(square) == pytest.approx(8.0) and flat_area(square[[0, 1, 2, 2]]) == pytest.approx(4.0)
    assert flat_area(square[[0, 1, 4, 2]]) == pytest.approx(4.0)  # one inside the triangle
    assert flat_area(square[[0, 0, 1, 1]]) == pytest.approx(0.0, abs=1e-12) and flat_area(square[[1, 1, 1, 1]]) == 0
    assert np.isnan(flat_area(np.full((4, 3), np.nan)))
