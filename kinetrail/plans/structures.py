"""Registered queries of sources, network attributes, trajectories as objects, generators, descriptors and the landmark pipeline."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point
from ..operators import clustering, descriptors, landmarks, plots, positions, series
from ..operators.network import SiteNetwork, index_atoms
from ..operators.trajectory import SiteTrajectory, from_matrix
from ..sources.archive import read_archive, write_archive
from ..sources.tables import load_trajectory, save_trajectory
from ..sources.voronoi_text import parse_nodes, structure_text
from . import fixtures as fx
from .catalogue import _COUNTS, _centers, _landmarks, _nation_sites, _network, _predict_sql, _r, _xyz, query
from .fixtures import CELL
from .session import checkpointed, shared_path

CENTER = ("cx", "cy", "cz")


def _rounded(names) -> list:
    return [_r(c).alias(c) for c in names]


def _particles(spark, sf_dir) -> SiteTrajectory:
    """Every particle as a mobile atom, every nation as a static one, with positions of all atoms in all frames."""
    at = fx.positions(spark, sf_dir)
    flags = lambda static: (F.lit(8 if static else 3).alias("atomic_number"), F.lit("O" if static else "Li").alias("symbol"), F.lit(1.0).alias("mass"))
    mobile = at.select(F.col("mobile").cast("long").alias("atom_id")).distinct().select("atom_id", *flags(False), *(F.lit(0.0).alias(c) for c in "xyz"), F.lit(False).alias("is_static"), F.lit(True).alias("is_mobile"))
    held = fx.centers(spark, sf_dir).select((F.col("id") + 1_000_000).cast("long").alias("atom_id"), *flags(True), "x", "y", "z", F.lit(True).alias("is_static"), F.lit(False).alias("is_mobile"))
    atoms = index_atoms(mobile.unionByName(held))
    still = at.select("frame").distinct().join(F.broadcast(held.select("atom_id", "x", "y", "z")))  # the nations in every frame
    frames = at.select("frame", F.col("mobile").cast("long").alias("atom_id"), "x", "y", "z").unionByName(still.select("frame", "atom_id", "x", "y", "z"))
    names = F.broadcast(atoms.where("is_mobile").select(F.col("atom_id").alias("mobile"), "mobile_idx"))
    assign = at.join(names, "mobile").select("frame", F.col("mobile_idx").cast("long").alias("mobile"), "site")
    return SiteTrajectory(SiteNetwork(atoms, CELL, _nation_sites(spark, sf_dir)), assign).with_frames(frames)


# ---- sources


@query(f"with {_COUNTS} select src, dst, n_ij from nij")
def archived_edges(spark, sf_dir):
    network, file = _network(spark, sf_dir), io.BytesIO()
    write_archive(SiteNetwork(network.atoms, CELL, network.sites, network.edges.select("src", "dst", "n_ij")), file)
    file.seek(0)
    return read_archive(spark, file).edges.select("src", "dst", "n_ij")


@query(f"with {fx.CENTERS} select cast(id as integer) as site_id, round(x, 6) as cx, round(y, 6) as cy, round(z, 6) as cz, cast(id % 2 as integer) as site_type from ct")
def archived_sites(spark, sf_dir):
    network, file = _network(spark, sf_dir), io.BytesIO()
    write_archive(SiteNetwork(network.atoms, CELL, network.sites), file)
    file.seek(0)
    return read_archive(spark, file).sites.select("site_id", *_rounded(CENTER), "site_type")


@query(f"with {fx.GRAPH} select frame, mobile, site from g")
def stored_trajectory(spark, sf_dir):
    path = shared_path(spark, "trajectory")
    save_trajectory(SiteTrajectory(_network(spark, sf_dir), fx.graph_daily(spark, sf_dir)), path, frames_per_part=7)
    return load_trajectory(spark, path).assign.select("frame", "mobile", "site")


@query(f"with {fx.CENTERS} select cast(id as integer) as node, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z, round(1 + id / 1e1, 3) as radius, concat(id, ' ', id * 3) as atoms from ct")
def parsed_nodes(spark, sf_dir):
    text = F.format_string("%d %.4f %.4f %.4f %.3f %d %d", "id", "x", "y", "z", 1 + F.col("id") / 10, "id", F.col("id") * 3)
    rows = fx.centers(spark, sf_dir).select((F.col("id") + 1).cast("int").alias("line"), text.alias("text"))
    head = spark.createDataFrame([(0, "Vertex table:"), (1000, "Edge table:"), (1001, "0 -> 1 0.5 0 0 0 1.0")], "line int, text string")
    nodes, _ = parse_nodes(head.unionByName(rows))
    return nodes.select("node", *(_r(c, 4).alias(c) for c in "xyz"), _r("radius", 3).alias("radius"), F.array_join(F.transform("atoms", lambda a: a.cast("string")), " ").alias("atoms"))


@query(f"with {fx.CENTERS} select 'O' as symbol, {_xyz(fx.sql_fractional(('x', 'y', 'z')), ('fx', 'fy', 'fz'))} from ct")
def structure_lines(spark, sf_dir):
    atoms = fx.centers(spark, sf_dir).select(F.col("id").alias("atom_id"), F.lit("O").alias("symbol"), "x", "y", "z")
    words = F.split("value", " ")
    atoms_only = structure_text(atoms, CELL).where(F.size(words) == 4)
    return atoms_only.select(words[0].alias("symbol"), *(_r(words[i + 1].cast("double")).alias(c) for i, c in enumerate(("fx", "fy", "fz"))))


# ---- trajectories as objects


@query(f"with {fx.DAILY} select frame, row_number() over (partition by frame order by mobile) - 1 as mobile, site from d")
def matrix_assignments(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("mobile", "site")))
    wide = fx.daily(spark, sf_dir).groupBy("frame").agg(F.transform(rows, lambda r: r["site"]).alias("sites"))
    return from_matrix(wide).select("frame", "mobile", "site")


@query(f"with {fx.GRAPH} select cast((frame - 2) // 3 as bigint) as frame, mobile, site from g where frame >= 2 and frame < 20 and (frame - 2) % 3 = 0")
def sliced_frames(spark, sf_dir):
    return SiteTrajectory(_network(spark, sf_dir), fx.graph_daily(spark, sf_dir)).slice(2, 20, 3).assign.select("frame", "mobile", "site")


@query(f"with {fx.GRAPH} select frame, mobile, site from g where mobile = 7")
def one_particle(spark, sf_dir):
    return SiteTrajectory(_network(spark, sf_dir), fx.graph_daily(spark, sf_dir)).particle(7).select("frame", "mobile", "site")


@query(f"with {fx.DAILY} select frame, mobile, site from d where frame % 3 = 0")
def every_third_frame(spark, sf_dir):
    return series.every(fx.daily(spark, sf_dir), 3).select("frame", "mobile", "site")


@query(f"with {fx.POSITIONS} select frame, cast(mobile as bigint) as atom_id, site, {_xyz(('x', 'y', 'z'))} from po")
def trajectory_positions(spark, sf_dir):
    return _particles(spark, sf_dir).positions().select("frame", "atom_id", "site", *_rounded("xyz"))


@query(f"""with {fx.POSITIONS}, {fx.CENTERS} select frame, cast(mobile as bigint) as atom_id, {', '.join(f'round(case when site < 0 then po.{c} else ct.{c} end, 6) as {c}' for c in 'xyz')} from po left join ct on ct.id = po.site
union all select f.frame, cast(ct.id + 1000000 as bigint), round(x, 6), round(y, 6), round(z, 6) from (select distinct frame from po) f cross join ct""")
def clamped_frames(spark, sf_dir):
    return positions.clamped_trajectory(_particles(spark, sf_dir), wrap=True, pass_through=True).select("frame", "atom_id", *_rounded("xyz"))


@query(f"with {fx.DAILY}, s as (select frame, site, count(*) as n from d where site >= 0 group by all) select count(*) filter (n > 1) as n_multiple, round(avg(n), 6) as mean_occupancy from s")
def checked_occupancy(spark, sf_dir):
    found = SiteTrajectory(_network(spark, sf_dir), fx.daily(spark, sf_dir)).check_multiple_occupancy(10**9)
    return spark.createDataFrame([found], "n_multiple long, mean_occupancy double").withColumn("mean_occupancy", _r("mean_occupancy"))


# ---- network attributes


@query(f"with {fx.CENTERS} select cast(id as integer) as site_id, cast(case when id % 3 = 0 then id * 10 else -1 end as integer) as weight from ct")
def site_attribute(spark, sf_dir):
    network, k = _network(spark, sf_dir), F.col("site_id")
    values = network.sites.where(k % 3 == 0).select(k, (k * 10).cast("int").alias("weight"))
    return network.add_site_attribute("weight", values, default=F.lit(-1)).weight


@query(f"with {_COUNTS}, w as (select * from (values (0, 0), (1, 6), (3, 20), (24, 2)) t(src, dst)) select cast(w.src as integer) as src, cast(w.dst as integer) as dst, coalesce(n_ij, 0e0) as n_ij from w left join nij on nij.src = w.src and nij.dst = w.dst")
def edge_lookup(spark, sf_dir):
    network = _network(spark, sf_dir)
    rows = [network.get_edge(a, b).select("src", "dst", "n_ij") for a, b in ((0, 0), (1, 6), (3, 20), (24, 2))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(f"with {fx.CENTERS} select cast(id as integer) as site_id, round(x, 6) as cx, round(y, 6) as cy, round(z, 6) as cz, cast(id % 2 as integer) as site_type from ct where id = 3")
def one_site(spark, sf_dir):
    return _network(spark, sf_dir).get_site(3).select("site_id", *_rounded(CENTER), "site_type")


@query(f"with {fx.CENTERS} select cast(id as integer) as site_id, round(x + 25e-2, 6) as cx, round(y + 25e-2, 6) as cy, round(z + 25e-2, 6) as cz, cast(id % 2 as integer) as site_type from ct")
def moved_centers(spark, sf_dir):
    network = _network(spark, sf_dir)
    moved = network.sites.select("site_id", *((F.col(c) + 0.25).alias(c) for c in CENTER))
    return network.update_centers(moved).sites.select("site_id", *_rounded(CENTER), "site_type")


@query(f"with {fx.CENTERS} select cast(id as integer) as site_id, round(-x, 6) as cx, round(y, 6) as cy, round(z, 6) as cz from ct")
def replaced_centers(spark, sf_dir):
    network = _network(spark, sf_dir)
    return network.with_centers(network.sites.withColumn("cx", -F.col("cx"))).sites.select("site_id", *_rounded(CENTER))


@query(f"with {fx.CENTERS} select distinct cast(id % 2 as integer) as site_type from ct")
def type_list(spark, sf_dir):
    return _network(spark, sf_dir).types


@query(f"with {_COUNTS} select nij.src, nij.dst, n_ij, round(jump_lag, 6) as jump_lag from nij left join lg on lg.src = nij.src and lg.dst = nij.dst")
def removed_attribute(spark, sf_dir):
    return _network(spark, sf_dir).remove_attribute("p_ij").edges.select("src", "dst", "n_ij", _r("jump_lag").alias("jump_lag"))


@query(f"with {fx.CENTERS} select cast(id as integer) as site_id, 4 as number_of_vertices from ct")
def vertex_counts(spark, sf_dir):
    return SiteNetwork(_network(spark, sf_dir).atoms, CELL, _landmarks(spark, sf_dir)).number_of_vertices


@query(f"with {fx.POINTS} select cast(id as integer) as atom_id, cast(case id % 3 when 0 then 8 else 14 end as integer) as atomic_number from pt where id % 3 < 2")
def host_atoms(spark, sf_dir):
    network = _network(spark, sf_dir)
    kinds = F.element_at(F.array(F.lit(8), F.lit(14), F.lit(3)), (F.col("atom_id") % 3 + 1).cast("int"))
    typed = SiteNetwork(network.atoms.withColumn("atomic_number", kinds), CELL)
    return descriptors.host_structure(typed, ("Si", 8)).select("atom_id", "atomic_number")


@query(f"with {fx.CENTERS} select cast(id as integer) as site_type, 6 as n, 6 as inside from ct")
def points_around(spark, sf_dir):
    around = positions.points_around_sites(_network(spark, sf_dir), 6, 0.3).sites
    inside = CELL.contains(point(*CENTER)).cast("int")
    return around.groupBy("site_type").agg(F.count("*").cast("int").alias("n"), F.sum(inside).cast("int").alias("inside"))


# ---- vectors and descriptors


@query(_predict_sql("greatest(floor(5e-2 * (select count(*) from a where label >= 0)), 1)") + """, c2 as (select * from c where center in (select label from z)), k2 as (select center, row_number() over (order by center) - 1 as k from c2),
s2 as (select v.vec_id, k2.k, round(abs(list_inner_product(v.e, c2.e) / sqrt(list_inner_product(v.e, v.e)) / sqrt(list_inner_product(c2.e, c2.e))), 9) as sim from v cross join c2 join k2 on k2.center = c2.center),
b2 as (select vec_id, arg_max(k, (sim, -k)) as k, max(sim) as sim from s2 group by vec_id) select vec_id, cast(case when sim >= 3e-1 then k else -1 end as integer) as label, round(case when sim >= 3e-1 then sim else 0e0 end, 6) as confidence from b2""")
def cosine_fit_predict(spark, sf_dir):
    labels, _ = clustering.fit_predict(fx.vectors(spark, sf_dir), 0.3, 0.05, centers=_centers(spark, sf_dir))
    return labels.withColumn("confidence", _r("confidence"))


def _tetrahedra_sql() -> str:
    ref = fx.sql_distance(("ct.x", "ct.y", "ct.z"), ("pt.x", "pt.y", "pt.z"))
    moved = fx.sql_recentred(("x", "y", "z"), ("cx", "cy", "cz"))
    side = lambda a, b: [f"({c}{b} - {c}{a})" for c in "xyz"]
    cross = lambda u, v: [f"({u[i]} * {v[j]} - {u[j]} * {v[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    area = " + ".join("sqrt(" + " + ".join(f"pow({c}, 2)" for c in cross(side(a, b), side(a, d))) + ") / 2" for a, b, d in ((1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)))
    volume = " + ".join(f"{u} * {w}" for u, w in zip(cross(side(1, 2), side(1, 3)), side(1, 4)))
    corners = ", ".join(f"max({c}) filter (k = {k}) as {c}{k}" for c in "xyz" for k in range(1, 5))
    return f"""with {fx.POINTS}, {fx.CENTERS}, v as (select * from (select ct.id as site_id, ct.x as cx, ct.y as cy, ct.z as cz, pt.x, pt.y, pt.z, row_number() over (partition by ct.id order by round({ref}, 9), pt.id) as k from pt cross join ct) where k <= 4),
m as (select site_id, k, {', '.join(f'{c} as {n}' for c, n in zip(moved, 'xyz'))} from v), t as (select site_id, {corners} from m group by site_id),
h as (select site_id, abs({volume}) / 6 as volume, {area} as area from t) select cast(site_id as integer) as site_id, round(volume, 6) as volume, round(area, 6) as area from h"""


@query(_tetrahedra_sql())
def vertex_volumes(spark, sf_dir):
    found = positions.site_volumes(SiteNetwork(_supplier_atoms(spark, sf_dir), CELL, _landmarks(spark, sf_dir)))
    return found.select("site_id", _r("volume").alias("volume"), _r("area").alias("area"))


def _supplier_atoms(spark, sf_dir) -> DataFrame:
    """Suppliers as static atoms that keep their number."""
    k = F.col("id").cast("int")
    return fx.points(spark, sf_dir).select(k.alias("atom_id"), F.lit(8).alias("atomic_number"), F.lit("O").alias("symbol"), F.lit(16.0).alias("mass"), "x", "y", "z", F.lit(True).alias("is_static"), F.lit(False).alias("is_mobile"), k.alias("static_idx"), F.lit(None).cast("int").alias("mobile_idx"))


def _suppliers(spark, sf_dir) -> SiteNetwork:
    return SiteNetwork(_supplier_atoms(spark, sf_dir), CELL, _nation_sites(spark, sf_dir))


@query(f"""with {fx.POINTS}, {fx.CENTERS}, n as (select ct.id, count(pt.id) as n, coalesce(string_agg(pt.id, ' ' order by pt.id), '') as vertices from ct left join pt on {fx.sql_distance(('ct.x', 'ct.y', 'ct.z'), ('pt.x', 'pt.y', 'pt.z'))} <= 25e-1 group by ct.id),
e as (select *, case when n > 0 then concat('CN:', n) else 'BAD:0' end as environment from n)
select cast(id as integer) as site_id, cast(n as integer) as coordination_number, vertices, environment, cast(dense_rank() over (order by environment) - 1 as integer) as site_type from e""")
def coordination(spark, sf_dir):
    found = descriptors.coordination_environments(_suppliers(spark, sf_dir), 2.5)
    return found.select("site_id", "coordination_number", F.array_join(F.transform("vertices", lambda v: v.cast("string")), " ").alias("vertices"), "environment", "site_type")


def _shells_sql(points: str, key: str) -> str:
    """The radial part of the built-in descriptor: Gaussian shells of the distances to all images within 3."""
    names = ("ex", "ey", "ez")
    rows = " union all ".join(f"select s, sqrt(pow({q[0]} - ax, 2) + pow({q[1]} - ay, 2) + pow({q[2]} - az, 2)) as r from p" for _, q in fx.sql_images(names))
    a, b = fx.sql_wrap(("a.x", "a.y", "a.z")), fx.sql_wrap(("pt.x", "pt.y", "pt.z"))
    return f"""with {fx.POINTS}, {fx.CENTERS}, a as ({points}), p as (select a.s, {', '.join(f'{c} as {k}' for c, k in zip(a, ('ax', 'ay', 'az')))}, {', '.join(f'{c} as {k}' for c, k in zip(b, names))} from a cross join pt),
im as ({rows}), z as (select unnest(range(6)) as pos), d as (select im.s, z.pos, sum(exp(-5e-1 * pow((r - pos * 6e-1) / 4e-1, 2)) * 5e-1 * (cos(pi() * r / 3) + 1)) as value from im cross join z where r < 3 and r > 1e-9 group by all)
select cast(a.s as bigint) as sample_id, {key}, cast(z.pos as integer) as pos, round(coalesce(d.value, 0), 5) as value from a cross join z left join d on d.s = a.s and d.pos = z.pos"""


def _shells(found: DataFrame) -> DataFrame:
    return found.select("sample_id", "site_id", F.posexplode(F.slice("v", 1, 6)).alias("pos", "value")).withColumn("value", _r("value", 5))


@query(_shells_sql("select id as s, x, y, z from ct", "cast(a.s as integer) as site_id"))
def descriptor_centers(spark, sf_dir):
    return _shells(descriptors.StructureDescriptor().of_centers(_suppliers(spark, sf_dir)))


@query(_shells_sql("select id as s, x + 3e-1 as x, y - 2e-1 as y, z from ct", "cast(a.s % 5 as integer) as site_id"))
def descriptor_samples(spark, sf_dir):
    sites = _nation_sites(spark, sf_dir).select("site_id", (F.col("cx") + 0.3).alias("cx"), (F.col("cy") - 0.2).alias("cy"), "cz", (F.col("site_id") % 5).cast("int").alias("site_type"))
    network = _suppliers(spark, sf_dir)
    return _shells(descriptors.StructureDescriptor().of_samples(network, SiteNetwork(network.atoms, CELL, sites)))


def _where_they_are(structure, species, environment, cell, points):
    """A backend that describes a point by its coordinates and the structure's size."""
    import numpy as np

    return np.column_stack([points, np.full(len(points), float(len(structure)))])


@query(f"""with {fx.POSITIONS}, {fx.CENTERS}, r as (select *, (row_number() over (partition by site order by frame, mobile) - 1) // 4 as grp, count(*) over (partition by site) as n from po where site >= 0 and frame % 2 = 0)
select cast(site as integer) as site_id, grp, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z, cast((select count(*) from ct) as double) as atoms from r where grp < n // 4 group by site, grp""")
def descriptor_averages(spark, sf_dir):
    from pyspark.sql import Window

    found = descriptors.StructureDescriptor(backend=_where_they_are).averaged(_particles(spark, sf_dir), stepsize=2, averaging=4)
    group = (F.row_number().over(Window.partitionBy("site_id").orderBy("sample_id")) - 1).cast("long").alias("grp")
    return found.select("site_id", group, *(_r(F.col("v")[i]).alias(c) for i, c in enumerate("xyz")), F.col("v")[3].alias("atoms"))


@query(f"""with {fx.POSITIONS}, s as (select mobile, frame, sqrt(pow(lead(x) over w - x, 2) + pow(lead(y) over w - y, 2) + pow(lead(z) over w - z, 2)) as v from po window w as (partition by mobile order by frame)),
n as (select count(distinct frame) - 1 as n from po), k as (select unnest(range(0, (select n // 2 + 1 from n))) as k),
p as (select mobile, k, pow(sum(v * cos(2 * pi() * k * frame / n)), 2) + pow(sum(v * sin(2 * pi() * k * frame / n)), 2) as power from s cross join k cross join n where v is not null group by mobile, k),
f as (select mobile, sum(power * k / n) / sum(power) as frequency from p cross join n where k > 0 group by mobile) select round(avg(frequency), 6) as mean, round(stddev_pop(frequency), 6) as deviation from f""")
def mean_vibration(spark, sf_dir):
    frames = fx.positions(spark, sf_dir).withColumnRenamed("mobile", "atom_id")
    return positions.average_vibrational_frequency(frames).select(_r("mean").alias("mean"), _r("deviation").alias("deviation"))


# ---- site types and the landmark pipeline, which SQL cannot say


@query()
def type_decisions(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), F.col("label").alias("site_id"), "v")
    peaks = descriptors.density_peaks(checkpointed(descriptors.principal_components(rows)))
    return plots.decision_curve(peaks).select("rank", "sample_id", *(_r(c).alias(c) for c in ("density", "delta", "decision")))


def landmark_inputs(spark, sf_dir) -> tuple[SiteNetwork, DataFrame]:
    """A mobile atom among the nations, a frame for each particle and day; landmarks beside the nations, with their four nearest as vertices."""
    at = fx.positions(spark, sf_dir)
    beside = fx.centers(spark, sf_dir).select(F.col("id").cast("int").alias("site_id"), (F.col("x") + 0.7).alias("cx"), (F.col("y") + 0.4).alias("cy"), (F.col("z") + 0.2).alias("cz"))
    d = fx.centers(spark, sf_dir).join(F.broadcast(beside)).select("site_id", *CENTER, F.col("id").cast("int").alias("id"), _r(CELL.distance(point(*CENTER), point("x", "y", "z")), 9).alias("d"))
    best = d.groupBy("site_id", *CENTER).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, 4).alias("n"))
    sites = best.select("site_id", *CENTER, F.sort_array(F.transform("n", lambda s: s["id"])).alias("vertices"))
    still = fx.centers(spark, sf_dir).select(F.col("id").cast("int").alias("atom_id"), F.lit(8).alias("atomic_number"), F.lit("O").alias("symbol"), F.lit(16.0).alias("mass"), "x", "y", "z", F.lit(True).alias("is_static"), F.lit(False).alias("is_mobile"))
    mover = spark.createDataFrame([(1000, 3, "Li", 7.0, 0.0, 0.0, 0.0, False, True)], still.schema)
    moment = (F.col("mobile") * 31 + F.col("frame")).cast("long").alias("frame")
    moving = at.select(moment, F.lit(1000).alias("atom_id"), "x", "y", "z")
    frames = moving.unionByName(moving.select("frame").join(F.broadcast(still.select("atom_id", "x", "y", "z"))))
    return SiteNetwork(index_atoms(still.unionByName(mover)), CELL, sites), frames


LANDMARK_OPTIONS = {"cutoff_midpoint": 2.5, "cutoff_steepness": 5.0, "check_for_zero_landmarks": False, "static_movement_threshold": 1.0, "relaxed_lattice_checks": True, "minimum_site_occupancy": 0.005, "clustering_parameters": {"clustering_threshold": 0.6, "assignment_threshold": 0.7}}


@query()
def landmark_analysis(spark, sf_dir):
    st = landmarks.LandmarkAnalysis(**LANDMARK_OPTIONS).run(*landmark_inputs(spark, sf_dir))
    return st.assign.join(F.broadcast(st.network.sites.withColumnRenamed("site_id", "site")), "site", "left").select("frame", "site", _r("confidence").alias("confidence"), *_rounded(CENTER))
