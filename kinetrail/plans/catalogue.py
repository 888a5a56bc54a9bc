"""Registered queries over the driver's tables, each with an independent SQL formulation where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.elbow import elbow_index
from ..functions.geometry import near_pairs, nearest_image, pairwise_distances, periodic_mean, point, recenter, staged, time_average
from ..operators import clustering, descriptors, graph, landmarks, merging, pathways, plots, positions, series, trajectory
from ..operators import jump_statistics as js
from ..operators.network import SiteNetwork, index_atoms
from . import fixtures as fx
from .fixtures import CELL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BEFORE = "(partition by mobile order by frame rows between unbounded preceding and 1 preceding)"
AFTER = "(partition by mobile order by frame rows between 1 following and unbounded following)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _eff(source: str) -> str:
    """The effective-site series of a CTE of assignments."""
    return f"""e0 as (select frame, mobile, site, case when frame = 0 then site else coalesce(last_value(nullif(site, -1) ignore nulls) over {BEFORE}, -1) end as lk from {source}),
e1 as (select *, case when site >= 0 then site else lk end as eff from e0),
e2 as (select *, eff >= 0 and lk >= 0 as fk, eff >= 0 and lk >= 0 and eff <> lk as jumped from e1),
e as (select *, frame - coalesce(max(case when jumped then frame end) over {BEFORE}, -1) as lag from e2),
nij as (select lk as src, eff as dst, cast(count(distinct frame) as double) as n_ij from e where fk group by all),
tt as (select eff as site_id, count(distinct frame) as t from e where fk group by all),
lg as (select src, dst, avg(lag) as jump_lag from (select lk as src, eff as dst, frame, arg_max(lag, mobile) as lag from e where jumped group by all) group by all),
nf as (select count(distinct frame) as n from {source})"""


def _n_frames(assign: DataFrame) -> int:
    return assign.agg(F.countDistinct("frame")).first()[0]


def _r(c, n: int = 6):
    return F.round(c, n)


# ---- series


@query(f"with {fx.DAILY}, {_eff('d')} select nij.src, nij.dst, n_ij, round(jump_lag, 6) as jump_lag from nij left join lg on lg.src = nij.src and lg.dst = nij.dst")
def jump_stats(spark, sf_dir):
    return js.transitions(series.effective(fx.daily(spark, sf_dir))).withColumn("jump_lag", _r("jump_lag"))


@query(f"with {fx.EVENTS}, p as (select *, coalesce(last_value(nullif(site, -1) ignore nulls) over {BEFORE}, -1) as from_site from ev) select frame, mobile, from_site, site as to_site from p where frame > 0 and site >= 0 and site <> from_site")
def jumps_known(spark, sf_dir):
    return series.jumps(fx.events(spark, sf_dir))


@query(f"with {fx.EVENTS}, p as (select *, lag(site) over (partition by mobile order by frame) as from_site from ev) select frame, mobile, from_site, site as to_site from p where frame > 0 and site <> from_site")
def jumps_unknown(spark, sf_dir):
    return series.jumps(fx.events(spark, sf_dir), unknown_as_jump=True)


@query(f"""with {fx.DAILY}, p as (select *, coalesce(last_value(nullif(site, -1) ignore nulls) over {BEFORE}, -1) as from_site from d),
j as (select * from p where frame > 0 and site >= 0 and site <> from_site)
select f.frame, count(j.mobile) as n_jumps, coalesce(string_agg(j.mobile || ':' || j.from_site || '>' || j.site, ' ' order by j.mobile), '') as jumps
from (select distinct frame from d where frame > 0) f left join j on j.frame = f.frame group by f.frame""")
def jumps_by_frame(spark, sf_dir):
    text = F.array_join(F.transform("jumps", lambda j: F.concat(j["mobile"].cast("string"), F.lit(":"), j["from_site"].cast("string"), F.lit(">"), j["to_site"].cast("string"))), " ")
    return series.jumps_by_frame(fx.daily(spark, sf_dir)).select("frame", F.size("jumps").cast("long").alias("n_jumps"), text.alias("jumps"))


_TIME = f"""tu as (select *, frame - coalesce(last_value(case when site >= 0 then frame end ignore nulls) over {BEFORE}, -1) - 1 as time,
coalesce(last_value(nullif(site, -1) ignore nulls) over {BEFORE}, -1) as before, coalesce(first_value(nullif(site, -1) ignore nulls) over {AFTER}, -1) as after from d)"""


@query(f"with {fx.DAILY}, {_TIME} select frame, mobile, case when site < 0 and time < 2 then before else site end as site from tu")
def fill_last_known(spark, sf_dir):
    return series.assign_to_last_known(fx.daily(spark, sf_dir), 2).select("frame", "mobile", "site")


@query(f"""with {fx.DAILY}, {_TIME}
select cast(coalesce(max(case when site >= 0 and time > 1 then time end), 0) as bigint) as max_time_unknown, round(coalesce(avg(case when site >= 0 and time > 0 then time end), 0), 6) as avg_time_unknown,
       count(case when site < 0 and time < 1 then 1 end) as total_reassigned from tu""")
def fill_stats(spark, sf_dir):
    return series.fill_statistics(fx.daily(spark, sf_dir), 1).withColumn("avg_time_unknown", _r("avg_time_unknown"))


@query(f"with {fx.DAILY}, {_TIME} select frame, mobile, case when site < 0 then after else site end as site from tu")
def fill_next_known(spark, sf_dir):
    return series.replace_unassigned(fx.daily(spark, sf_dir), "next").select("frame", "mobile", "site")


def _closer_sql() -> str:
    here = ("po.x", "po.y", "po.z")
    d = {k: fx.sql_distance(here, (f"{k}.x", f"{k}.y", f"{k}.z")) for k in ("cb", "ca")}
    return f"""with {fx.POSITIONS}, {_TIME}, {fx.CENTERS}
select tu.frame, tu.mobile, case when tu.site >= 0 then tu.site when after < 0 then before when before < 0 then after when {d['cb']} < {d['ca']} then before else after end as site
from tu join po on po.frame = tu.frame and po.mobile = tu.mobile left join ct cb on cb.id = before left join ct ca on ca.id = after"""


def _nation_sites(spark, sf_dir) -> DataFrame:
    return fx.centers(spark, sf_dir).select(F.col("id").cast("int").alias("site_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))


@query(_closer_sql())
def fill_closer(spark, sf_dir):
    at = fx.positions(spark, sf_dir)
    return series.replace_with_closer(at.select("frame", "mobile", "site"), at, _nation_sites(spark, sf_dir), CELL).select("frame", "mobile", "site")


def _mode_sql(keep: bool) -> str:
    return f"""with {fx.DAILY}, c as (select a.frame, a.mobile, a.site as own, b.site, count(*) as n from d a join d b on b.mobile = a.mobile and b.frame between a.frame - 3 and a.frame + 3 group by all),
r as (select *, row_number() over (partition by frame, mobile order by n desc, site) as k from c)
select frame, mobile, case when n >= 3 then site else {'own' if keep else '-1'} end as site from r where k = 1"""


@query(_mode_sql(False))
def rolling_mode_mark(spark, sf_dir):
    return series.rolling_mode(fx.daily(spark, sf_dir), 3).select("frame", "mobile", "site")


@query(_mode_sql(True))
def rolling_mode_keep(spark, sf_dir):
    return series.rolling_mode(fx.daily(spark, sf_dir), 3, set_unassigned=False).select("frame", "mobile", "site")


@query(f"""with {fx.EVENTS}, r as (select *, frame - row_number() over (partition by mobile, site order by frame) as run from ev)
select mobile, min(frame) as start, count(*) as length, site from r group by mobile, site, run""")
def rle_runs(spark, sf_dir):
    return series.runs(fx.events(spark, sf_dir)).select("mobile", "start", "length", "site")


@query(f"""with {fx.DAILY}, {fx.SITES}, r as (select *, frame - row_number() over (partition by mobile, site order by frame) as run from d)
select mobile, min(frame) as start, count(*) as length, site, site >= 0 as known, site_type from r left join st on st.site_id = site group by mobile, site, run, site_type""")
def timeline_segments(spark, sf_dir):
    return series.timeline(fx.daily(spark, sf_dir), fx.sites(spark)).select("mobile", "start", "length", "site", "known", "site_type")


@query(f"with {fx.POSITIONS}, q as (select frame, mobile as atom_id, lead(x) over w - x as dx, lead(y) over w - y as dy, lead(z) over w - z as dz from po window w as (partition by mobile order by frame)) select frame, atom_id, round(dx, 6) as dx, round(dy, 6) as dy, round(dz, 6) as dz from q where dx is not null")
def displacements(spark, sf_dir):
    frames = fx.positions(spark, sf_dir).withColumnRenamed("mobile", "atom_id")
    return series.displacements(frames).select("frame", "atom_id", *(_r(c).alias(c) for c in ("dx", "dy", "dz")))


# ---- aggregates over the trajectory


@query(f"with {fx.DAILY}, {fx.SITES} select site_id, round(count(d.site) / (select count(distinct frame) from d), 6) as occupancy from st left join d on d.site = st.site_id group by site_id")
def site_occupancy(spark, sf_dir):
    d = fx.daily(spark, sf_dir)
    return trajectory.occupancies(d, fx.sites(spark), _n_frames(d)).withColumn("occupancy", _r("occupancy"))


@query(f"with {fx.DAILY} select count(*) filter (site < 0) as n_unassigned, count(*) filter (site >= 0) as n_assigned, round(avg(case when site < 0 then 1e0 else 0e0 end), 6) as fraction_unassigned from d")
def unassigned_stats(spark, sf_dir):
    return trajectory.unassigned(fx.daily(spark, sf_dir)).withColumn("fraction_unassigned", _r("fraction_unassigned"))


@query(f"with {fx.DAILY}, s as (select frame, site, count(*) as n from d where site >= 0 group by all) select count(*) filter (n > 1) as n_multiple, round(avg(n), 6) as mean_occupancy from s")
def multi_occupancy(spark, sf_dir):
    return trajectory.multiple_occupancy(fx.daily(spark, sf_dir)).withColumn("mean_occupancy", _r("mean_occupancy"))


@query(f"with {fx.GRAPH}, {_eff('g')} select site_id, t as total_corrected_residences from tt")
def corrected_residence(spark, sf_dir):
    return js.corrected_residences(series.effective(fx.graph_daily(spark, sf_dir)))


@query(f"with {fx.GRAPH}, {_eff('g')} select src, dst, round(n_ij / t, 6) as p_ij from nij left join tt on tt.site_id = src")
def transition_prob(spark, sf_dir):
    return js.edge_statistics(series.effective(fx.graph_daily(spark, sf_dir))).select("src", "dst", _r("p_ij").alias("p_ij"))


@query(f"with {fx.GRAPH}, {_eff('g')} select src, dst, round(n_ij / t, 6) as p_ij from nij left join tt on tt.site_id = dst")
def transition_prob_legacy(spark, sf_dir):
    return js.edge_statistics(series.effective(fx.graph_daily(spark, sf_dir)), legacy=True).select("src", "dst", _r("p_ij").alias("p_ij"))


_S25 = "s25 as (select cast(range as integer) as site_id, cast(range % 2 as integer) as site_type from range(25))"


@query(f"with {fx.GRAPH}, {_eff('g')}, {_S25} select s25.site_id, round(coalesce(avg(jump_lag), (select n from nf)), 6) as residence_time from s25 left join lg on lg.src = s25.site_id group by s25.site_id")
def residence_time(spark, sf_dir):
    g = fx.graph_daily(spark, sf_dir)
    return js.residence_times(js.jump_lags(series.effective(g)), fx.sites(spark, 25), _n_frames(g)).withColumn("residence_time", _r("residence_time"))


@query(f"with {fx.GRAPH}, {_eff('g')}, {_S25} select s25.site_id, round(coalesce(sum(n_ij), 0) / (select n from nf), 6) as occupancy_freq from s25 left join nij on nij.dst = s25.site_id group by s25.site_id")
def occupancy_freq(spark, sf_dir):
    g = fx.graph_daily(spark, sf_dir)
    return js.occupancy_frequencies(js.transition_counts(series.effective(g)), fx.sites(spark, 25), _n_frames(g)).withColumn("occupancy_freq", _r("occupancy_freq"))


@query(f"""with {fx.GRAPH}, {_eff('g')}, {_S25}, ty as (select distinct site_type as t from s25),
m as (select a.site_type as tf, b.site_type as t2, avg(jump_lag) as l, count(*) as n from lg join s25 a on a.site_id = src join s25 b on b.site_id = dst group by all)
select a.t as type_from, b.t as type_to, round(l, 6) as jump_lag, coalesce(n, 0) as n_pairs from ty a cross join ty b left join m on tf = a.t and t2 = b.t""")
def jump_lag_by_type(spark, sf_dir):
    lags = js.jump_lags(series.effective(fx.graph_daily(spark, sf_dir)))
    return js.jump_lag_by_type(lags, fx.sites(spark, 25)).withColumn("jump_lag", _r("jump_lag"))


@query(f"""with {fx.GRAPH}, {_eff('g')}, {_S25}, k as (select site_type, count(*) * 1e0 as nn, sum(coalesce(t, 0)) / (select n from nf) as n from s25 left join tt on tt.site_id = s25.site_id group by all)
select round(-sum(case when n / nn in (0, 1) then 0 else nn * (n / nn * ln(n / nn) + (1 - n / nn) * ln(1 - n / nn)) end) / sum(n), 6) as entropy from k""")
def config_entropy(spark, sf_dir):
    g = fx.graph_daily(spark, sf_dir)
    return js.configurational_entropy(js.corrected_residences(series.effective(g)), fx.sites(spark, 25), _n_frames(g)).select(_r("entropy").alias("entropy"))


@query(f"with {fx.GRAPH}, {_eff('g')} select nij.src, nij.dst, round(jump_lag, 6) as jump_lag, n_ij from nij left join lg on lg.src = nij.src and lg.dst = nij.dst where n_ij >= 2 and nij.src <> nij.dst")
def lag_plot_data(spark, sf_dir):
    return js.plot_lags(js.edge_statistics(series.effective(fx.graph_daily(spark, sf_dir))), 2).withColumn("jump_lag", _r("jump_lag"))


# ---- selection


@query(f"with {fx.GRAPH}, u as (select * from g), m as (select site as site_id, row_number() over (order by site) - 1 as new_id from (select distinct site from u where site >= 0)) select frame, mobile, cast(coalesce(new_id, -1) as integer) as site from u left join m on m.site_id = u.site")
def remove_unoccupied(spark, sf_dir):
    u = fx.graph_daily(spark, sf_dir)  # visits 25 of the 30 sites
    return trajectory.translate(u, trajectory.unoccupied_translation(u, fx.sites(spark, 30))).select("frame", "mobile", "site")


def _network(spark, sf_dir) -> SiteNetwork:
    edges = js.edge_statistics(series.effective(fx.graph_daily(spark, sf_dir)))
    rows = _nation_sites(spark, sf_dir).withColumn("site_type", (F.col("site_id") % 2).cast("int"))
    k = F.col("id")
    static = fx.points(spark, sf_dir).select(k.cast("int").alias("atom_id"), F.lit(8).alias("atomic_number"), F.lit("O").alias("symbol"), F.lit(16.0).alias("mass"), "x", "y", "z", F.lit(True).alias("is_static"), F.lit(False).alias("is_mobile"))
    return SiteNetwork(index_atoms(static), CELL, rows, edges)


@query(f"with {fx.GRAPH}, {_eff('g')}, m as (select range as o, row_number() over (order by range) - 1 as k from range(25) where range % 3 = 0) select cast(a.k as integer) as src, cast(b.k as integer) as dst, n_ij from nij join m a on a.o = src join m b on b.o = dst")
def induced_subnetwork(spark, sf_dir):
    return _network(spark, sf_dir).subset(F.col("site_id") % 3 == 0).edges.select("src", "dst", "n_ij")


@query(f"with {fx.CENTERS} select cast(row_number() over (order by id) - 1 as integer) as site_id, round(x, 6) as cx, round(y, 6) as cy, round(z, 6) as cz from ct where id % 2 = 1")
def of_type(spark, sf_dir):
    sub = _network(spark, sf_dir).subset(F.col("site_type") == 1).sites
    return sub.select("site_id", *(_r(c).alias(c) for c in ("cx", "cy", "cz")))


@query(f"with {fx.CENTERS}, {fx.POINTS} select atomic_number, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, is_site from (select 8 as atomic_number, x, y, z, false as is_site from pt union all select 3, x, y, z, true from ct)")
def structure_with_sites(spark, sf_dir):
    return _network(spark, sf_dir).structure_with_sites(3).select("atomic_number", *(_r(c).alias(c) for c in "xyz"), "is_site")


# ---- geometry


def _xyz(p, names="xyz", n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) as {k}" for c, k in zip(p, names))


_P = ("x", "y", "z")


@query(f"with {fx.POINTS} select id, {_xyz(fx.sql_wrap(_P))} from pt")
def wrap_points(spark, sf_dir):
    return fx.points(spark, sf_dir).select("id", *(_r(c).alias(n) for c, n in zip(CELL.wrap(point("x", "y", "z")), "xyz")))


@query(f"with {fx.POINTS} select id, {_xyz(fx.sql_fractional(_P), ('fx', 'fy', 'fz'))} from pt")
def cell_coords(spark, sf_dir):
    return fx.points(spark, sf_dir).select("id", *(_r(c).alias(n) for c, n in zip(CELL.fractional(point("x", "y", "z")), ("fx", "fy", "fz"))))


@query(f"with {fx.POINTS} select id, {' and '.join(f'{c} >= 0 and {c} < 1' for c in fx.sql_fractional(_P))} as inside, {', '.join(f'cast(floor({c}) as integer) as {k}' for c, k in zip(fx.sql_fractional(_P), ('i', 'j', 'k')))} from pt")
def cell_images(spark, sf_dir):
    p = point("x", "y", "z")
    return fx.points(spark, sf_dir).select("id", CELL.contains(p).alias("inside"), *(c.alias(n) for c, n in zip(CELL.image(p), "ijk")))


@query(f"with {fx.POINTS}, {fx.CENTERS} select pt.id as point_id, ct.id as center_id, round({fx.sql_distance(('ct.x', 'ct.y', 'ct.z'), ('pt.x', 'pt.y', 'pt.z'))}, 6) as distance from pt cross join ct")
def pbc_distance(spark, sf_dir):
    c = F.broadcast(fx.centers(spark, sf_dir).select(F.col("id").alias("center_id"), *(F.col(k).alias(f"c{k}") for k in "xyz")))  # the 25 nations
    joined = fx.points(spark, sf_dir).withColumnRenamed("id", "point_id").join(c)
    return joined.select("point_id", "center_id", _r(CELL.distance(point("cx", "cy", "cz"), point("x", "y", "z"))).alias("distance"))


@query(f"with {fx.CENTERS} select a.id as i, b.id as j, case when a.id = b.id then 0e0 when a.id < b.id then round({fx.sql_distance(('a.x', 'a.y', 'a.z'), ('b.x', 'b.y', 'b.z'))}, 6) else round({fx.sql_distance(('b.x', 'b.y', 'b.z'), ('a.x', 'a.y', 'a.z'))}, 6) end as distance from ct a cross join ct b")
def pairwise_distance(spark, sf_dir):
    return pairwise_distances(fx.centers(spark, sf_dir), CELL).withColumn("distance", _r("distance"))


def _min_image_sql() -> str:
    ref, p = fx.sql_wrap(("ct.x", "ct.y", "ct.z")), fx.sql_wrap(("pt.x", "pt.y", "pt.z"))
    names = ("wx", "wy", "wz")
    rows = " union all ".join(f"select center_id, point_id, {code} as code, sqrt(pow({q[0]} - rx, 2) + pow({q[1]} - ry, 2) + pow({q[2]} - rz, 2)) as dist from w" for code, q in fx.sql_images(names))
    return f"""with {fx.POINTS}, {fx.CENTERS}, w as (select ct.id as center_id, pt.id as point_id, {', '.join(f'{c} as {k}' for c, k in zip(ref, ('rx', 'ry', 'rz')))}, {', '.join(f'{c} as {k}' for c, k in zip(p, names))} from pt cross join ct),
a as ({rows}) select center_id, point_id, round(min(dist), 6) as distance from a group by all"""


@query(_min_image_sql())
def min_image(spark, sf_dir):
    c = F.broadcast(fx.centers(spark, sf_dir).select(F.col("id").alias("center_id"), *(F.col(k).alias(f"c{k}") for k in "xyz")))
    joined = fx.points(spark, sf_dir).withColumnRenamed("id", "point_id").join(c)
    joined = staged(joined, r=CELL.wrap(point("cx", "cy", "cz")), w=CELL.wrap(point("x", "y", "z")))
    found = nearest_image(joined, CELL, point("rx", "ry", "rz"), point("wx", "wy", "wz"))
    return found.select("center_id", "point_id", _r("image_distance").alias("distance"))


@query(f"with {fx.POINTS}, {fx.CENTERS}, x as (select ct.id as center_id, pt.id as point_id, {fx.sql_distance(('ct.x', 'ct.y', 'ct.z'), ('pt.x', 'pt.y', 'pt.z'))} as r from pt cross join ct) select center_id, point_id, round(r, 6) as distance from x where r <= 2e0")
def near_neighbours(spark, sf_dir):
    a = fx.centers(spark, sf_dir).withColumnRenamed("id", "id_a")
    b = fx.points(spark, sf_dir).withColumnRenamed("id", "id_b")
    return near_pairs(a, b, CELL, 2.0).select(F.col("id_a").alias("center_id"), F.col("id_b").alias("point_id"), _r("distance").alias("distance"))


def _mean_sql(weight: bool) -> str:
    rank = "order by w desc, frame, mobile" if weight else "order by frame, mobile"
    w = "w" if weight else "1e0"
    moved = fx.sql_recentred(("x", "y", "z"), ("px", "py", "pz"))
    back = fx.sql_wrap(tuple(f"({a} - {float(c)!r}e0 + {p})" for a, c, p in zip(("mx", "my", "mz"), CELL.centroid, ("px", "py", "pz"))))
    return f"""with {fx.POSITIONS}, q0 as (select frame, mobile, site, x, y, z, (mobile % 7 + frame % 3) * 1e0 as w from po where site >= 0),
q1 as (select *, first_value(x) over v as px, first_value(y) over v as py, first_value(z) over v as pz from q0 window v as (partition by site {rank})),
q2 as (select site, px, py, pz, {w} as w, {', '.join(f'{c} as {k}' for c, k in zip(moved, ('qx', 'qy', 'qz')))} from q1),
q3 as (select site, px, py, pz, sum(w * qx) / sum(w) as mx, sum(w * qy) / sum(w) as my, sum(w * qz) / sum(w) as mz, count(*) as n from q2 group by site, px, py, pz)
select site, {_xyz(back)}, n from q3"""


def _weighted_positions(spark, sf_dir) -> DataFrame:
    return fx.positions(spark, sf_dir).where("site >= 0").withColumn("w", (F.col("mobile") % 7 + F.col("frame") % 3).cast("double"))


@query(_mean_sql(False))
def periodic_mean_sites(spark, sf_dir):
    return periodic_mean(_weighted_positions(spark, sf_dir), CELL, ["site"], ["frame", "mobile"]).select("site", *(_r(c).alias(c) for c in "xyz"), "n")


@query(_mean_sql(True))
def periodic_weighted_mean(spark, sf_dir):
    return periodic_mean(_weighted_positions(spark, sf_dir), CELL, ["site"], ["frame", "mobile"], "w").select("site", *(_r(c).alias(c) for c in "xyz"), "n")


def _time_average_sql() -> str:
    moved = fx.sql_recentred(("x", "y", "z"), ("px", "py", "pz"))
    back = fx.sql_wrap(tuple(f"({a} - {float(c)!r}e0 + {p})" for a, c, p in zip(("mx", "my", "mz"), CELL.centroid, ("px", "py", "pz"))))
    return f"""with {fx.POSITIONS}, q1 as (select *, first_value(x) over v as px, first_value(y) over v as py, first_value(z) over v as pz from po window v as (partition by mobile order by frame)),
q2 as (select mobile, px, py, pz, {', '.join(f'avg({c}) as {k}' for c, k in zip(moved, ('mx', 'my', 'mz')))} from q1 group by mobile, px, py, pz)
select mobile as atom_id, {_xyz(back, n=5)} from q2"""


@query(_time_average_sql())
def time_averages(spark, sf_dir):
    frames = fx.positions(spark, sf_dir).withColumnRenamed("mobile", "atom_id")
    return time_average(frames, CELL).select("atom_id", *(_r(c, 5).alias(c) for c in "xyz"))


@query(f"""with {fx.POSITIONS}, a as (select mobile as atom_id, mobile % 2 = 0 as is_static, 1e0 + mobile % 3 as mass from (select distinct mobile from po)),
c as (select frame, sum(mass * x) / sum(mass) as sx, sum(mass * y) / sum(mass) as sy, sum(mass * z) / sum(mass) as sz from po join a on a.atom_id = po.mobile where is_static group by frame)
select po.frame, mobile as atom_id, {_xyz(tuple(f'{k} - s{k} + {float(v)!r}e0' for k, v in zip('xyz', CELL.centroid)))} from po join c on c.frame = po.frame""")
def recenter_frames(spark, sf_dir):
    frames = fx.positions(spark, sf_dir).withColumnRenamed("mobile", "atom_id")
    atoms = frames.select("atom_id").distinct().select("atom_id", (F.col("atom_id") % 2 == 0).alias("is_static"), (1.0 + F.col("atom_id") % 3).alias("mass"))
    return recenter(frames, atoms, CELL).select("frame", "atom_id", *(_r(c).alias(c) for c in "xyz"))


@query(f"""with {fx.POINTS}, {fx.CENTERS}, x as (select pt.id as point_id, ct.id as center_id, round({fx.sql_distance(('pt.x', 'pt.y', 'pt.z'), ('ct.x', 'ct.y', 'ct.z'))}, 6) as r from pt cross join ct)
select point_id, arg_min(center_id, (r, center_id)) as center_id, min(r) as distance from x group by point_id""")
def nearest_site(spark, sf_dir):
    c = F.broadcast(fx.centers(spark, sf_dir).select(F.col("id").alias("center_id"), *(F.col(k).alias(f"c{k}") for k in "xyz")))
    d = fx.points(spark, sf_dir).withColumnRenamed("id", "point_id").join(c).select("point_id", "center_id", _r(CELL.distance(point("x", "y", "z"), point("cx", "cy", "cz"))).alias("r"))
    return d.groupBy("point_id").agg(F.min(F.struct("r", "center_id")).alias("m")).select("point_id", F.col("m")["center_id"].alias("center_id"), F.col("m")["r"].alias("distance"))


# ---- positions


@query(f"with {fx.POSITIONS} select frame, mobile, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from po where site = 2")
def site_positions(spark, sf_dir):
    at = fx.positions(spark, sf_dir)
    atoms = at.select(F.col("mobile").alias("atom_id"), F.lit(3).alias("atomic_number"), *(F.lit(0.0).alias(c) for c in "xyz"), F.lit(False).alias("is_static"), F.lit(True).alias("is_mobile")).distinct()
    numbered = index_atoms(atoms)
    names = numbered.select(F.col("atom_id").alias("mobile"), "mobile_idx")
    assign = at.join(names, "mobile").select("frame", F.col("mobile_idx").cast("long").alias("mobile"), "site")
    st = trajectory.SiteTrajectory(SiteNetwork(numbered, CELL), assign, at.withColumnRenamed("mobile", "atom_id"))
    joined = st.positions_for_site(2).select("frame", F.col("atom_id").alias("mobile"), "x", "y", "z")
    return joined.select("frame", "mobile", *(_r(c).alias(c) for c in "xyz"))


@query(f"with {fx.POSITIONS}, {fx.CENTERS} select frame, mobile, {', '.join(f'round(case when site < 0 then po.{c} else ct.{c} end, 6) as {c}' for c in 'xyz')} from po left join ct on ct.id = po.site")
def clamped_positions(spark, sf_dir):
    return positions.clamped(fx.positions(spark, sf_dir), _nation_sites(spark, sf_dir), CELL, wrap=True).select("frame", "mobile", *(_r(c).alias(c) for c in "xyz"))


def _clamped_sql() -> str:
    names, real, home = ("wx", "wy", "wz"), ("po.x", "po.y", "po.z"), ("ct.x", "ct.y", "ct.z")
    cols = [f"{c} as {k}" for c, k in zip(fx.sql_wrap(real), ("rx", "ry", "rz"))] + [f"{c} as {k}" for c, k in zip(fx.sql_wrap(home), names)] + [f"floor({c}) as {k}" for c, k in zip(fx.sql_fractional(real), ("i", "j", "k"))]
    rows = " union all ".join(f"select frame, mobile, {code} as code, sqrt(pow({q[0]} - rx, 2) + pow({q[1]} - ry, 2) + pow({q[2]} - rz, 2)) as dist from w where site >= 0" for code, q in fx.sql_images(names))
    shift = fx.sql_cartesian(("(i + code // 100 - 1)", "(j + code // 10 % 10 - 1)", "(k + code % 10 - 1)"))
    at = ", ".join(f"round(case when w.site < 0 then w.{c} else w.{n} + {s} end, 6) as {c}" for c, n, s in zip("xyz", names, shift))
    return f"""with {fx.POSITIONS}, {fx.CENTERS}, w as (select frame, mobile, site, po.x, po.y, po.z, {', '.join(cols)} from po left join ct on ct.id = po.site),
a as ({rows}), m as (select frame, mobile, arg_min(code, (round(dist, 9), code)) as code from a group by all)
select w.frame, w.mobile, {at} from w left join m on m.frame = w.frame and m.mobile = w.mobile"""


@query(_clamped_sql())
def clamped_nearest_image(spark, sf_dir):
    return positions.clamped(fx.positions(spark, sf_dir), _nation_sites(spark, sf_dir), CELL).select("frame", "mobile", *(_r(c).alias(c) for c in "xyz"))


def _averages_sql() -> str:
    moved = fx.sql_recentred(("x", "y", "z"), ("px", "py", "pz"))
    back = fx.sql_wrap(tuple(f"({a} - {float(c)!r}e0 + {p})" for a, c, p in zip(("mx", "my", "mz"), CELL.centroid, ("px", "py", "pz"))))
    return f"""with {fx.POSITIONS}, q0 as (select *, (row_number() over (partition by site order by frame, mobile) - 1) % 4 as part from po where site >= 0),
q1 as (select *, first_value(x) over v as px, first_value(y) over v as py, first_value(z) over v as pz from q0 window v as (partition by site, part order by frame, mobile)),
q2 as (select site, part, px, py, pz, {', '.join(f'avg({c}) as {k}' for c, k in zip(moved, ('mx', 'my', 'mz')))} from q1 group by site, part, px, py, pz)
select site, cast(part as integer) as part, {_xyz(back)} from q2"""


@query(_averages_sql())
def n_avgs_per_site(spark, sf_dir):
    return positions.averages_per_site(fx.positions(spark, sf_dir), fx.sites(spark), CELL, 4, weighted=False).select("site", "part", *(_r(c).alias(c) for c in "xyz"))


@query(f"""with {fx.POSITIONS}, s as (select mobile, frame, sqrt(pow(lead(x) over w - x, 2) + pow(lead(y) over w - y, 2) + pow(lead(z) over w - z, 2)) as v from po window w as (partition by mobile order by frame)),
n as (select count(distinct frame) - 1 as n from po), k as (select unnest(range(0, (select n // 2 + 1 from n))) as k),
p as (select mobile, k, pow(sum(v * cos(2 * pi() * k * frame / n)), 2) + pow(sum(v * sin(2 * pi() * k * frame / n)), 2) as power from s cross join k cross join n where v is not null group by mobile, k)
select mobile as atom_id, round(sum(power * k / n) / sum(power), 6) as frequency from p cross join n where k > 0 group by mobile""")
def vibrational_freq(spark, sf_dir):
    frames = fx.positions(spark, sf_dir).withColumnRenamed("mobile", "atom_id")
    return positions.vibrational_frequencies(frames).withColumn("frequency", _r("frequency"))


@query()
def site_volume(spark, sf_dir):
    return positions.accessible_volumes(fx.positions(spark, sf_dir), CELL).select("site", _r("volume").alias("volume"), _r("area").alias("area"))


# ---- vectors


_CV = "v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), c as (select label as center, e from v where vec_id in (select min(vec_id) from embeddings group by label))"


def _centers(spark, sf_dir) -> DataFrame:
    return fx.vectors(spark, sf_dir).groupBy("label").agg(F.min_by("v", "vec_id").alias("v")).withColumnRenamed("label", "center")


def _predict_sql(least: int | str) -> str:
    return f"""with {_CV}, s as (select v.vec_id, c.center, round(abs(list_inner_product(v.e, c.e) / sqrt(list_inner_product(v.e, v.e)) / sqrt(list_inner_product(c.e, c.e))), 9) as sim from v cross join c),
b as (select vec_id, arg_max(center, (sim, -center)) as k, max(sim) as sim from s group by vec_id),
a as (select vec_id, case when sim >= 3e-1 then k else -1 end as label, case when sim >= 3e-1 then sim else 0e0 end as confidence from b), z as (select label from a where label >= 0 group by label having count(*) >= {least})"""


@query(_predict_sql(1) + " select vec_id, cast(label as integer) as label, round(confidence, 6) as confidence from a")
def cosine_assign(spark, sf_dir):
    return clustering.predict(fx.vectors(spark, sf_dir), _centers(spark, sf_dir), 0.3).withColumn("confidence", _r("confidence"))


@query(_predict_sql(12) + " select label, count(*) as n from a where label in (select label from z) group by label")
def cosine_assign_min_samples(spark, sf_dir):
    labels = clustering.predict(fx.vectors(spark, sf_dir), _centers(spark, sf_dir), 0.3)
    return clustering.large_clusters(labels, 12)


_SPARSE = "sp as (select vec_id, label, pos, cast(embedding[pos + 1] as double) as v from embeddings, (select unnest(range(64)) as pos))"


def _sparse(spark, sf_dir) -> DataFrame:
    return clustering.sparsified(fx.vectors(spark, sf_dir))


@query(f"with {_SPARSE}, n as (select count(*) * 1e0 as n from embeddings), m as (select a.pos as k, b.pos as l, sum(a.v * b.v) / (select n from n) as v from sp a join sp b on b.vec_id = a.vec_id group by all), s as (select k, sqrt(v) as s from m where k = l) select cast(m.k as integer) as k, cast(m.l as integer) as l, round(v / a.s / b.s, 6) as value from m join s a on a.k = m.k join s b on b.k = m.l")
def landmark_corr(spark, sf_dir):
    n = fx.table(spark, sf_dir, "embeddings").count()
    return clustering.correlations(clustering.second_moments(_sparse(spark, sf_dir), n)).withColumn("value", _r("value"))


@query(f"with {_SPARSE} select label, cast(pos as integer) as pos, round(sum(v * (1 + vec_id % 3)) / sum(1 + vec_id % 3), 6) as v from sp group by label, pos")
def representative_vectors(spark, sf_dir):
    labels = fx.vectors(spark, sf_dir).select("vec_id", "label", (1.0 + F.col("vec_id") % 3).alias("confidence"))
    return clustering.representatives(_sparse(spark, sf_dir), labels).withColumn("v", _r("v"))


@query()
def leader_clusters(spark, sf_dir):
    found = clustering.fit_centers(fx.vectors(spark, sf_dir), 0.3)  # one chunk up to 50,000 vectors
    return found.select("center", "n", _r(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"))


@query()
def leader_clusters_two_level(spark, sf_dir):
    found = clustering.fit_centers(fx.vectors(spark, sf_dir), 0.3, chunk=64)
    return found.select("center", "n")


def _elbow_sql() -> str:
    return """with c as (select label, sum(list_sum(list_transform(embedding, lambda x: abs(cast(x as double))))) as v from embeddings group by label), r as (select v, row_number() over (order by v desc) - 1 as i from c),
e as (select max(i) as n, max(v) as hi, min(v) as lo from r), d as (select i, round(abs(n * (v - hi) - i * (lo - hi)), 9) as d from r cross join e) select cast(arg_max(i, (d, -i)) as integer) as elbow from d"""


@query(_elbow_sql())
def elbow(spark, sf_dir):
    curve = fx.vectors(spark, sf_dir).groupBy("label").agg(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("value"))
    return elbow_index(curve, "value")


@query("with c as (select label as site_id, vec_id % 4 - 1 as label, count(*) as n from embeddings group by all), w as (select site_id, arg_max(label, (n, -label)) filter (label >= 0) as site_type, max(n) filter (label >= 0) as n, sum(n) as a from c group by site_id) select site_id, cast(site_type as integer) as site_type, round(n / a, 6) as share from w")
def type_votes(spark, sf_dir):
    labels = fx.vectors(spark, sf_dir).select(F.col("label").alias("site_id"), (F.col("vec_id") % 4 - 1).cast("int").alias("label"))
    return descriptors.votes(labels).withColumn("share", _r("share"))


@query()
def pca_types(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select(F.col("vec_id").alias("sample_id"), F.col("label").alias("site_id"), "v")
    return descriptors.site_types(rows)[0].withColumn("share", _r("share"))


@query("with r as (select vec_id, label, (row_number() over (partition by label order by vec_id) - 1) // 5 as grp, count(*) over (partition by label) as n, embedding as e from embeddings) select cast(label as integer) as site_id, grp, cast(p as integer) as pos, round(avg(cast(e[p + 1] as double)), 6) as value from r cross join (select unnest(range(64)) as p) where grp < n // 5 group by label, grp, p")
def consecutive_averages(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select(F.col("vec_id").alias("frame"), F.lit(0).alias("mobile"), F.col("label").alias("site"), "v")
    found = descriptors.consecutive_averages(rows, averaging=5)
    order = Window.partitionBy("site_id").orderBy("sample_id")
    return found.withColumn("grp", (F.row_number().over(order) - 1).cast("long")).select("site_id", "grp", F.posexplode("v").alias("pos", "value")).withColumn("value", _r("value"))


# ---- graph


_COUNTS = f"{fx.GRAPH}, {_eff('g')}, {_S25}"


def _threshold(spark, sf_dir) -> DataFrame:
    return js.transition_counts(series.effective(fx.graph_daily(spark, sf_dir)))


@query(f"""with recursive {_COUNTS}, k as (select src as a, dst as b from nij where n_ij >= 4 union select dst, src from nij where n_ij >= 4),
r as (select site_id as a, site_id as b from s25 union select r.a, k.b from r join k on k.a = r.b),
c as (select a as site_id, min(b) as component, count(*) as n from r group by a), o as (select component, row_number() over (order by component) - 1 as p from (select distinct component from c where n >= 2))
select site_id, cast(coalesce(p, -1) as integer) as pathway from c left join o on o.component = c.component""")
def diffusion_pathways(spark, sf_dir):
    return pathways.site_pathways(_threshold(spark, sf_dir), fx.sites(spark, 25), 4, minimum_n_sites=2)


@query(f"""with recursive {_COUNTS}, k as (select src as a, dst as b from nij where n_ij >= 4), r as (select site_id as a, site_id as b from s25 union select r.a, k.b from r join k on k.a = r.b)
select x.a as site_id, min(x.b) as component from r x join r y on y.a = x.b and y.b = x.a group by x.a""")
def strong_components(spark, sf_dir):
    return graph.strong_components(pathways.connected_edges(_threshold(spark, sf_dir), 4), fx.sites(spark, 25)).select("site_id", "component")


@query(f"with {_COUNTS} select src, dst, n_ij from nij where n_ij >= 9e-3 * (select sum(n_ij) from nij where src <> dst)")
def connectivity_fraction(spark, sf_dir):
    return pathways.connected_edges(_threshold(spark, sf_dir), 0.009).select("src", "dst", "n_ij")


@query(f"with {_COUNTS} select distinct cast(a.site as integer) as src, cast(b.site as integer) as dst from g a join g b on b.frame = a.frame where a.site >= 0 and b.site >= 0")
def co_occupied_sites(spark, sf_dir):
    return merging.co_occupied(fx.graph_daily(spark, sf_dir))


def _biased_sql() -> str:
    d = fx.sql_distance(("a.x", "a.y", "a.z"), ("b.x", "b.y", "b.z"))
    back = fx.sql_distance(("b.x", "b.y", "b.z"), ("a.x", "a.y", "a.z"))
    return f"""with {_COUNTS}, {fx.CENTERS}, x as (select nij.src, nij.dst, n_ij / t as p, jump_lag, case when nij.src = nij.dst then 0e0 when nij.src < nij.dst then {d} else {back} end as r
from nij join tt on tt.site_id = nij.src left join lg on lg.src = nij.src and lg.dst = nij.dst join ct a on a.id = nij.src join ct b on b.id = nij.dst)
select src, dst, round((p + case when jump_lag is null then 0 else exp(-5e-1 * pow((jump_lag - 1) / 2e1, 2)) end) * (5e-1 * exp(-5e-1 * pow(r, 2)) + 5e-1), 6) as connectivity from x"""


@query(_biased_sql())
def connectivity_biased(spark, sf_dir):
    return merging.connectivity_jump_lag_biased()(_network(spark, sf_dir)).withColumn("connectivity", _r("connectivity"))


@query(f"with {_COUNTS}, o as (select coalesce(sum(n_ij), 0) as s, coalesce(sum(n_ij * n_ij), 0) as q from nij where src <> dst) select round(s / 6e2 + 3 * sqrt(q / 6e2 - pow(s / 6e2, 2)), 6) as threshold from o")
def edge_alarm(spark, sf_dir):
    return merging.alarming_edges(_threshold(spark, sf_dir), "n_ij", 25).select(_r("threshold").alias("threshold"))


@query(f"""with recursive {_COUNTS}, {fx.CENTERS}, k as (select nij.src as a, nij.dst as b from nij join ct a on a.id = src join ct b on b.id = dst
  where n_ij >= 2 and case when src = dst then 0e0 when src < dst then {fx.sql_distance(('a.x', 'a.y', 'a.z'), ('b.x', 'b.y', 'b.z'))} else {fx.sql_distance(('b.x', 'b.y', 'b.z'), ('a.x', 'a.y', 'a.z'))} end <= 6),
r as (select site_id as a, site_id as b from s25 union select r.a, k.b from r join k on k.a = r.b), c as (select x.a as site_id, min(x.b) as g from r x join r y on y.a = x.b and y.b = x.a group by x.a)
select frame, mobile, cast(coalesce(o.k, -1) as integer) as site from g left join c on c.site_id = g.site left join (select g, row_number() over (order by g) - 1 as k from (select distinct g from c)) o on o.g = c.g""")
def merge_by_threshold(spark, sf_dir):
    network = _network(spark, sf_dir)
    merge = merging.MergeSitesByThreshold(check_types=False, threshold=2, distance_threshold=6.0, weighted_spatial_average=False)
    return merge.run(trajectory.SiteTrajectory(network, fx.graph_daily(spark, sf_dir))).assign.select("frame", "mobile", "site")


def _merged_sql(rest: str = "") -> str:
    """Merged sites from a CTE c (site_id, g): unweighted periodic means of the members' centers."""
    moved = fx.sql_recentred(("x", "y", "z"), ("px", "py", "pz"))
    back = fx.sql_wrap(tuple(f"({a} - {float(c)!r}e0 + {p})" for a, c, p in zip(("mx", "my", "mz"), CELL.centroid, ("px", "py", "pz"))))
    return f""", q1 as (select c.site_id, g, x, y, z, first_value(x) over v as px, first_value(y) over v as py, first_value(z) over v as pz from c join ct on ct.id = c.site_id window v as (partition by g order by c.site_id)),
q2 as (select g, px, py, pz, {', '.join(f'avg({c}) as {k}' for c, k in zip(moved, ('mx', 'my', 'mz')))} from q1 group by g, px, py, pz)
select cast(row_number() over (order by q2.g) - 1 as integer) as site_id, {_xyz(back, ('cx', 'cy', 'cz'))}{rest}"""


_STRONG = "r as (select site_id as a, site_id as b from s25 union select r.a, k.b from r join k on k.a = r.b), c as (select x.a as site_id, min(x.b) as g from r x join r y on y.a = x.b and y.b = x.a group by x.a)"


def _apart(a: str, b: str, i: str, j: str) -> str:
    """Distance between the sites i, j at a and b: of the one with the lower number to the other."""
    p, q = tuple(f"{a}.{c}" for c in "xyz"), tuple(f"{b}.{c}" for c in "xyz")
    return f"case when {i} = {j} then 0e0 when {i} < {j} then {fx.sql_distance(p, q)} else {fx.sql_distance(q, p)} end"


@query(f"""with recursive {_COUNTS}, {fx.CENTERS}, k as (select nij.src as a, nij.dst as b from nij join ct a on a.id = src join ct b on b.id = dst where n_ij >= 2 and {_apart('a', 'b', 'src', 'dst')} <= 6),
{_STRONG}{_merged_sql(", (select string_agg(v, ' ' order by v) from (select distinct unnest([c.site_id, c.site_id * 7 % 25]) as v from c where c.g = q2.g)) as vertices, (select count(*) from c where c.g = q2.g) as n from q2")}""")
def merged_centers(spark, sf_dir):
    network = _network(spark, sf_dir)
    k = F.col("site_id")
    network = SiteNetwork(network.atoms, CELL, network.sites.drop("site_type").withColumn("vertices", F.array(k, (k * 7 % 25).cast("int"))), network.edges)
    merge = merging.MergeSitesByThreshold(check_types=False, threshold=2, distance_threshold=6.0, weighted_spatial_average=False, set_merged_into=True)
    out = merge.run(trajectory.SiteTrajectory(network, fx.graph_daily(spark, sf_dir))).network.sites
    sizes = merge.merged_from.sites.groupBy(F.col("merged_into").alias("site_id")).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform("vertices", lambda v: v.cast("string")), " ").alias("vertices")
    return out.join(sizes, "site_id").select("site_id", *(_r(c).alias(c) for c in ("cx", "cy", "cz")), text, "n")


@query()
def merge_by_dynamics(spark, sf_dir):
    merge = merging.MergeSitesByDynamics(check_types=False, distance_threshold=6.0, post_check_factor=None, weighted_spatial_average=False)
    out = merge.run(trajectory.SiteTrajectory(_network(spark, sf_dir), fx.graph_daily(spark, sf_dir)))
    return out.network.sites.select("site_id", *(_r(c).alias(c) for c in ("cx", "cy", "cz")))


def _barrier_sql() -> str:
    rows = " union all ".join(f"select i, j, {code} as code, {q[0]} as x, {q[1]} as y, {q[2]} as z, sqrt(pow({q[0]} - ax, 2) + pow({q[1]} - ay, 2) + pow({q[2]} - az, 2)) as dist from p" for code, q in fx.sql_images(("ex", "ey", "ez")))
    r = fx.sql_distance(("g.x", "g.y", "g.z"), ("pt.x", "pt.y", "pt.z"))
    return f"""with recursive {_COUNTS}, {fx.CENTERS}, {fx.POINTS}, near as (select nij.src, nij.dst from nij join ct a on a.id = src join ct b on b.id = dst where n_ij >= 1 and src <> dst and {_apart('a', 'b', 'src', 'dst')} <= 4),
p as (select i, j, a.x as ax, a.y as ay, a.z as az, b.x as ex, b.y as ey, b.z as ez from (select distinct least(src, dst) as i, greatest(src, dst) as j from near) join ct a on a.id = i join ct b on b.id = j),
im as ({rows}), q as (select i, j, arg_min((x, y, z), (round(dist, 9), code)) as q from im group by all),
gi as (select p.i, p.j, image, ax + image / 19e0 * (q.q[1] - ax) as x, ay + image / 19e0 * (q.q[2] - ay) as y, az + image / 19e0 * (q.q[3] - az) as z from p join q on q.i = p.i and q.j = p.j, (select unnest(range(20)) as image)),
en as (select i, j, image, coalesce(sum(4 * (pow(s, 12) - pow(s, 6))), 0) as energy from (select g.i, g.j, g.image, 1 / greatest(r, 1e-3) as s from (select g.i, g.j, g.image, {r} as r from gi g cross join pt) g where r <= 5) group by all),
ea as (select g.i, g.j, g.image, coalesce(energy, 0e0) as energy from gi g left join en on en.i = g.i and en.j = g.j and en.image = g.image),
t as (select i, j, arg_max(image, (energy, -image)) as peak, max(energy) as top, arg_min(energy, image) as first, arg_max(energy, image) as last from ea group by all),
k as (select i as a, j as b from t where peak not in (0, 19) and top - first <= 5 union all select j, i from t where peak not in (0, 19) and top - last <= 5
      union all select src, dst from near join t on i = least(src, dst) and j = greatest(src, dst) where peak in (0, 19)),
{_STRONG}{_merged_sql(' from q2')}"""


@query(_barrier_sql())
def merge_by_barrier(spark, sf_dir):
    merge = merging.MergeSitesByBarrier(check_types=False, maximum_pairwise_distance=4.0, barrier_threshold=5.0, weighted_spatial_average=False)
    out = merge.run(trajectory.SiteTrajectory(_network(spark, sf_dir), fx.graph_daily(spark, sf_dir)))
    return out.network.sites.select("site_id", *(_r(c).alias(c) for c in ("cx", "cy", "cz")))


@query()
def mcl_clusters(spark, sf_dir):
    sites = fx.sites(spark, 25)
    loops = sites.select(F.col("site_id").alias("src"), F.col("site_id").alias("dst"), F.lit(1.0).alias("n_ij"))
    edges = _threshold(spark, sf_dir).unionByName(loops).groupBy("src", "dst").agg(F.sum("n_ij").alias("n_ij"))
    return graph.markov_clusters(edges, sites, "n_ij")


def _periodic_sql() -> str:
    names = ("ex", "ey", "ez")
    rows = " union all ".join(f"select src, dst, {code} as code, sqrt(pow({q[0]} - ax, 2) + pow({q[1]} - ay, 2) + pow({q[2]} - az, 2)) as dist from p" for code, q in fx.sql_images(names))
    a, b = fx.sql_wrap(("a.x", "a.y", "a.z")), fx.sql_wrap(("b.x", "b.y", "b.z"))
    return f"""with recursive {_COUNTS}, {fx.CENTERS}, p as (select src, dst, {', '.join(f'{c} as {k}' for c, k in zip(a, ('ax', 'ay', 'az')))}, {', '.join(f'{c} as {k}' for c, k in zip(b, names))} from nij join ct a on a.id = src join ct b on b.id = dst where n_ij >= 2 and src <> dst),
im as ({rows}), ed as (select src, dst, arg_min(code, (round(dist, 9), code)) as code from im group by all),
sup as (select src * 27 + i * 9 + j * 3 + k as a, dst * 27 + (i + code // 100 - 1) * 9 + (j + code // 10 % 10 - 1) * 3 + k + code % 10 - 1 as b
        from ed, (select unnest(range(3)) as i), (select unnest(range(3)) as j), (select unnest(range(3)) as k) where i + code // 100 - 1 between 0 and 2 and j + code // 10 % 10 - 1 between 0 and 2 and k + code % 10 - 1 between 0 and 2),
both_ as (select a, b from sup union select b, a from sup), r as (select range as a, range as b from range(675) union select r.a, x.b from r join both_ x on x.a = r.b),
c as (select a as node, min(b) as comp from r group by a), mid as (select distinct comp from c where node % 27 = 13),
m as (select distinct comp, node // 27 as site_id, node % 27 as image from c where comp in (select comp from mid)),
perc as (select distinct comp from (select comp, site_id from m group by all having count(*) > 1)), ms as (select distinct comp, site_id from m where comp in (select comp from perc)),
j as (select comp as a, comp as b from perc union select j.a, y.comp from j join ms x on x.comp = j.b join ms y on y.site_id = x.site_id),
joint as (select a as comp, min(b) as grp from j group by a), f as (select grp, min(site_id) as first from ms join joint on joint.comp = ms.comp group by grp), n as (select grp, row_number() over (order by first) - 1 as pathway from f),
o as (select distinct site_id, pathway from ms join joint on joint.comp = ms.comp join n on n.grp = joint.grp)
select s25.site_id, cast(coalesce(pathway, -1) as integer) as pathway from s25 left join o on o.site_id = s25.site_id"""


@query(_periodic_sql())
def periodic_pathways(spark, sf_dir):
    return pathways.periodic_pathways(_threshold(spark, sf_dir), _nation_sites(spark, sf_dir), CELL, 2)[0]


def _segments_sql() -> str:
    rows = " union all ".join(f"select src, dst, v, back, {code} as code, sqrt(pow({q[0]} - ax, 2) + pow({q[1]} - ay, 2) + pow({q[2]} - az, 2)) as dist from p" for code, q in fx.sql_images(("ex", "ey", "ez")))
    return f"""with {_COUNTS}, {fx.CENTERS}, p as (select f.src, f.dst, f.n_ij as v, r.n_ij as back, a.x as ax, a.y as ay, a.z as az, b.x as ex, b.y as ey, b.z as ez
from nij f left join nij r on r.src = f.dst and r.dst = f.src join ct a on a.id = f.src join ct b on b.id = f.dst where f.src <> f.dst and f.n_ij > 2),
i as ({rows}), m as (select src, dst, v, back, arg_min(code, (round(dist, 9), code)) as code, min(dist) as dist from i group by all)
select src, dst, round(dist, 6) as length, (v + coalesce(back, 0)) / 2 as value, code <> 111 as outside from m where code <> 111 or src < dst or not coalesce(back > 2, false)"""


@query(_segments_sql())
def edge_segments(spark, sf_dir):
    found = plots.edge_segments(_threshold(spark, sf_dir), "n_ij", _nation_sites(spark, sf_dir), CELL, 2)
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2) + F.pow(F.col("z2") - F.col("z1"), 2))
    return found.select("src", "dst", _r(length).alias("length"), "value", "outside")


# ---- landmarks


def _landmarks(spark, sf_dir) -> DataFrame:
    """(site_id, cx, cy, cz, vertices): nations with their four nearest suppliers."""
    c = F.broadcast(_nation_sites(spark, sf_dir))
    d = fx.points(spark, sf_dir).join(c).select("site_id", "cx", "cy", "cz", F.col("id").cast("int").alias("id"), _r(CELL.distance(point("cx", "cy", "cz"), point("x", "y", "z")), 9).alias("d"))
    best = d.groupBy("site_id", "cx", "cy", "cz").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, 4).alias("n"))
    return best.select("site_id", "cx", "cy", "cz", F.transform("n", lambda s: s["id"]).alias("vertices"))


def _landmark_sql(mid: float = 2.5, steep: float = 5.0) -> str:
    ref = fx.sql_distance(("ct.x", "ct.y", "ct.z"), ("pt.x", "pt.y", "pt.z"))
    r = fx.sql_distance(("po.x", "po.y", "po.z"), ("v.x", "v.y", "v.z"))
    cut = landmarks.cutoff_point(mid, steep)
    return f"""with {fx.POSITIONS}, {fx.POINTS}, {fx.CENTERS}, v as (select * from (select ct.id as landmark, pt.id as vertex, pt.x, pt.y, pt.z, {ref} as d0, row_number() over (partition by ct.id order by round({ref}, 9), pt.id) as k from pt cross join ct) where k <= 4),
q as (select frame, mobile, landmark, {r} / d0 as r from po cross join v),
lv as (select frame, mobile, landmark, exp(avg(-ln(1 + exp({steep}e0 * (r - {mid}e0))))) as value from q where r <= {cut!r}e0 group by all having count(*) = 4)"""


def _landmark_vectors(spark, sf_dir, mid: float = 2.5, steep: float = 5.0) -> tuple[DataFrame, DataFrame]:
    mobile = fx.positions(spark, sf_dir).select("frame", "mobile", "x", "y", "z")
    static = fx.points(spark, sf_dir).select(F.col("id").cast("int").alias("static_idx"), "x", "y", "z")
    reference = landmarks.reference_distances(_landmarks(spark, sf_dir), static, CELL)
    return mobile, landmarks.landmark_vectors(mobile, static, reference, CELL, mid, steep)


@query(_landmark_sql() + " select frame, mobile, cast(landmark as integer) as landmark, round(value, 6) as value from lv")
def landmark_vectors(spark, sf_dir):
    return _landmark_vectors(spark, sf_dir)[1].withColumn("value", _r("value"))


@query(_landmark_sql(1.5, 30.0) + " select po.frame, po.mobile from po left join (select distinct frame, mobile from lv) l on l.frame = po.frame and l.mobile = po.mobile where l.frame is null")
def landmark_zero_check(spark, sf_dir):
    return landmarks.zero_vectors(*_landmark_vectors(spark, sf_dir, 1.5, 30.0))


def _lattice_sql() -> str:
    d = fx.sql_distance(("ct.x", "ct.y", "ct.z"), ("m.x", "m.y", "m.z"))
    return f"""with {fx.POSITIONS}, {fx.CENTERS}, m as (select frame, mobile as atom, x, y, z from po), x as (select frame, ct.id as lattice_point, atom, round({d}, 9) as d from m cross join ct),
n as (select frame, lattice_point, arg_min(atom, (d, atom)) as atom, min(d) as d from x group by all)
select frame, count(*) filter (d > 2e0) as too_far, count(*) - count(distinct atom) as repeated from n group by frame"""


@query(_lattice_sql())
def static_lattice_check(spark, sf_dir):
    frames = fx.positions(spark, sf_dir).select("frame", F.col("mobile").alias("static_idx"), "x", "y", "z")
    lattice = fx.centers(spark, sf_dir).withColumnRenamed("id", "lattice_point")
    near = landmarks.nearest_lattice(frames, lattice, CELL).withColumn("distance", _r("distance", 9))
    return landmarks.check_lattice(near, 2.0, every=True).select("frame", "too_far", "repeated")
