"""Operators on real positions: clamping, averages per site, points around sites, volumes, vibrations, Voronoi sites."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientCoordinatingAtomsError
from ..functions.geometry import Cell, nearest_image, periodic_mean, point, staged
from ..functions.hulls import convex_hull, flat_area, voronoi_nodes
from .network import SiteNetwork
from .series import site_ranks
from .trajectory import SiteTrajectory

#: Positions of a site that one task reduces to those on their hull.
SHARE = 20_000


def clamped(positions: DataFrame, sites: DataFrame, cell: Cell, wrap: bool = False, pass_through: bool = True) -> DataFrame:
    """(frame, mobile, x, y, z): each particle at its site's center.

    *positions*: (frame, mobile, site, x, y, z). Without *wrap* the image of
    the center nearest to the real position is taken. Unknown particles stay
    where they are, or raise.
    """
    joined = positions.join(F.broadcast(sites.select(F.col("site_id").alias("site"), "cx", "cy", "cz")), "site", "left")
    real, center = point("x", "y", "z"), point("cx", "cy", "cz")
    if wrap:
        at = center
    else:
        joined = staged(joined, __r=cell.wrap(real), __c=cell.wrap(center))
        joined = nearest_image(joined, cell, point("__rx", "__ry", "__rz"), point("__cx", "__cy", "__cz"), "__n").withColumnRenamed("__n_code", "__code")
        here = cell.image(real)
        digits = [F.floor(F.col("__code") / d) % 10 - 1 for d in (100, 10, 1)]
        home = cell.fractional(center)
        at = cell.cartesian(tuple(f - F.floor(f) + i + s for f, i, s in zip(home, here, digits)))
    unknown = F.col("site") < 0
    if not pass_through:
        unknown = F.when(unknown, F.raise_error(F.lit("a particle to clamp is unassigned")).cast("boolean")).otherwise(False)
    return joined.select("frame", "mobile", *(F.when(unknown, r).otherwise(a).alias(n) for r, a, n in zip(real, at, "xyz")))


def clamped_trajectory(st: SiteTrajectory, clamp: Column | None = None, wrap: bool = False, pass_through: bool = False) -> DataFrame:
    """(frame, atom_id, x, y, z): clamped atoms at site centers or structure positions, the others as they move.

    *clamp*: a predicate over atoms; all static and mobile ones by default.
    """
    atoms = st.network.atoms.withColumn("__clamp", clamp if clamp is not None else F.col("is_static") | F.col("is_mobile"))
    frames = st.assign.select("frame").distinct()
    fixed = frames.join(F.broadcast(atoms.where("__clamp and is_static").select("atom_id", "x", "y", "z")))
    chosen = atoms.where("__clamp and is_mobile").select("atom_id")
    moving = st.positions().join(F.broadcast(chosen), "atom_id", "left_semi")
    number = F.broadcast(atoms.where("is_mobile").select("atom_id", F.col("mobile_idx").alias("mobile")))
    moved = clamped(moving, st.network.sites, st.network.cell, wrap, pass_through).join(number, "mobile").select("frame", "atom_id", "x", "y", "z")
    rest = st.frames.join(F.broadcast(atoms.where("not __clamp or not (is_static or is_mobile)").select("atom_id")), "atom_id", "left_semi").select("frame", "atom_id", "x", "y", "z")
    return fixed.select("frame", "atom_id", "x", "y", "z").unionByName(moved).unionByName(rest)


def averages_per_site(positions: DataFrame, sites: DataFrame, cell: Cell, n: int, error_on_insufficient: bool = True, weighted: bool = True) -> DataFrame:
    """(site, part, x, y, z): n periodic averages of each site's positions, every n-th one going to the same average.

    Sites with n positions or fewer raise, or pass their positions through.
    """
    if n % 2:
        raise ValueError("n must be even")
    seen = positions.where("site >= 0")
    sizes = seen.groupBy("site").agg(F.count("*").alias("__n"))
    ranked = site_ranks(seen, "__i").join(F.broadcast(sizes), "site")  # a row a site
    if error_on_insufficient:
        short = sites.join(seen.groupBy("site").count(), sites.site_id == F.col("site"), "left").where(F.coalesce("count", F.lit(0)) <= n).select("site_id").limit(1).collect()
        if short:
            raise ValueError(f"site {short[0].site_id} has too few positions for {n} averages")
    parts = ranked.withColumn("part", F.when(F.col("__n") > n, F.col("__i") % n).otherwise(F.col("__i")).cast("int"))
    mean = periodic_mean(parts.where(F.col("__n") > n), cell, ["site", "part"], ["frame", "mobile"], "confidence" if weighted else None).drop("n")
    return mean.unionByName(parts.where(F.col("__n") <= n).select("site", "part", "x", "y", "z"))


def points_around_sites(network: SiteNetwork, n: int, sigma: float, seed: int = 0) -> SiteNetwork:
    """n Gaussian points around each site, wrapped, typed by the site they belong to."""
    rows = network.sites.select("site_id", "cx", "cy", "cz", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).coalesce(1)  # one partition, so that the seed decides
    moved = rows.select(F.col("site_id").alias("site_type"), "k", *((F.col(f"c{c}") + sigma * F.randn(seed + i)).alias(c) for i, c in enumerate("xyz")))
    wrapped = moved.select("site_type", (F.col("site_type") * n + F.col("k")).cast("int").alias("site_id"), *(c.alias(f"c{k}") for c, k in zip(network.cell.wrap(point("x", "y", "z")), "xyz")))
    return replace(network, sites=wrapped, edges=None, computed=frozenset())


def accessible_volumes(positions: DataFrame, cell: Cell, n_recenterings: int = 8) -> DataFrame:
    """(site, volume, area): the smallest hull of a site's positions over several recenterings; null if all are flat.

    Only positions on the hull matter: each task reduces its share of a site
    to extreme points in many directions and the hull of its share, so that a
    site's positions are never gathered whole.
    """
    pivots = positions.where("site >= 0").groupBy("site").agg(F.count("*").alias("n"))
    ranked = site_ranks(positions.where("site >= 0"), "__i").join(F.broadcast(pivots), "site")
    marks = F.array(*(F.floor(F.lit(k) * F.col("n") / n_recenterings) for k in range(n_recenterings)))
    chosen = ranked.where(F.array_contains(marks, F.col("__i"))).select("site", F.explode(F.filter(F.transform(marks, lambda m: F.struct(m.alias("m"), F.col("__i").alias("i"))), lambda t: t["m"] == t["i"])).alias("t"), F.struct("x", "y", "z").alias("pivot"))
    centers = chosen.groupBy("site").agg(F.array_distinct(F.collect_list("pivot")).alias("pivots"))  # n_recenterings at most
    parts = pivots.select("site", F.ceil(F.col("n") / SHARE).cast("int").alias("parts"))
    spread = positions.where("site >= 0").join(F.broadcast(centers.join(parts, "site")), "site").select("site", "parts", "x", "y", "z", F.posexplode("pivots").alias("k", "pivot"))
    moved = spread.select("site", "k", "parts", *(c.alias(n) for c, n in zip(cell.recentred(point("x", "y", "z"), tuple(F.col("pivot")[a] for a in "xyz")), "xyz")))

    def extremes(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[np.sort(hull_vertices(pdf[["x", "y", "z"]].to_numpy()))]

    salted = moved.withColumn("__salt", F.pmod(F.xxhash64("x", "y", "z"), F.col("parts"))).drop("parts")
    kept = salted.groupBy("site", "k", "__salt").applyInPandas(lambda pdf: extremes(pdf)[["site", "k", "x", "y", "z"]], salted.drop("__salt").schema)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        volume, area = convex_hull(pdf[["x", "y", "z"]].to_numpy())
        return pd.DataFrame({"site": [pdf["site"].iloc[0]], "volume": [volume], "area": [area]})

    each = kept.groupBy("site", "k").applyInPandas(measure, "site int, volume double, area double")
    return each.where(~F.isnan("volume")).groupBy("site").agg(F.min(F.struct("volume", "area")).alias("m")).select("site", "m.*").join(pivots.select("site"), "site", "right")


def hull_vertices(p: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Rows that can be vertices of the hull: a few thousand at most are kept whole, more are thinned chunk by chunk."""
    keep = np.arange(len(p))
    while len(keep) > 4000:
        parts = [keep[i : i + 1000] for i in range(0, len(keep), 1000)]
        fewer = np.concatenate([c[_on_hull(p[c])] for c in parts])
        if len(fewer) > 0.9 * len(keep):
            break
        keep = fewer
    return keep


def _on_hull(p: np.ndarray) -> np.ndarray:
    """Rows not strictly inside the polytope spanned by extremes in fixed directions."""
    draw = np.random.default_rng(5)
    d = draw.standard_normal((64, 3))
    top = np.unique((p @ d.T).argmax(0))
    core = p[top]
    if len(core) < 5:
        return np.arange(len(p))
    from itertools import combinations

    center = core.mean(0)
    inside = np.zeros(len(p), bool)
    for tet in combinations(range(min(len(core), 10)), 3):  # tetrahedra of the center and core triples
        m = np.column_stack([core[t] - center for t in tet])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        w = np.linalg.solve(m, (p - center).T)
        inside |= (w > 1e-9).all(0) & (w.sum(0) < 1 - 1e-9)
    return np.flatnonzero(~inside)


def site_volumes(network: SiteNetwork, error_on_insufficient: bool = True) -> DataFrame:
    """(site_id, volume, area) of each site's vertices about its center; with fewer than four vertices an error, or 0 and null.

    Vertices in one plane (or in one place) have no volume and the area of both sides.
    """
    cell = network.cell
    vertices = network.sites.select("site_id", "cx", "cy", "cz", F.size("vertices").alias("n"), F.explode_outer("vertices").alias("static_idx"))
    if error_on_insufficient and (short := vertices.where("n < 4").limit(1).collect()):
        raise InsufficientCoordinatingAtomsError(f"site {short[0].site_id} has only {short[0].n} vertices")
    at = vertices.join(F.broadcast(network.static_structure.select("static_idx", "x", "y", "z")), "static_idx", "left")
    moved = at.select("site_id", "n", *(c.alias(k) for c, k in zip(cell.recentred(point("x", "y", "z"), point("cx", "cy", "cz")), "xyz")))

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        p, enough = pdf[["x", "y", "z"]].to_numpy(), pdf["n"].iloc[0] >= 4
        volume, area = convex_hull(p) if enough else (0.0, float("nan"))
        if enough and np.isnan(volume) and not np.isnan(area := flat_area(p)):
            volume = 0.0
        return pd.DataFrame({"site_id": [pdf["site_id"].iloc[0]], "volume": [volume], "area": [area]})

    found = moved.groupBy("site_id").applyInPandas(measure, "site_id int, volume double, area double")
    return found.select("site_id", F.nanvl("volume", F.lit(None)).alias("volume"), F.nanvl("area", F.lit(None)).alias("area"))


def vibrational_frequencies(frames: DataFrame, min_frequency: float = 0.0, max_frequency: float = float("inf"), timestep: float = 1.0) -> DataFrame:
    """(atom_id, frequency): the mean frequency of an atom's speed, weighted by spectral power within the open band.

    Speeds are lengths of steps between frames, not periodic.  One atom's
    series is a row; rows go through Python in Arrow batches of many atoms.
    """
    order = Window.partitionBy("atom_id").orderBy("frame")
    step = [F.lead(c).over(order) - F.col(c) for c in "xyz"]
    speeds = frames.select("atom_id", "frame", F.sqrt(sum((s * s for s in step[1:]), step[0] * step[0])).alias("speed")).where("speed is not null")
    series = speeds.groupBy("atom_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "speed"))), lambda s: s["speed"]).alias("speeds"))

    @F.pandas_udf("double")
    def spectrum(rows: pd.Series) -> pd.Series:
        out = []
        for v in rows:
            power = np.abs(np.fft.rfft(v)) ** 2
            f = np.fft.rfftfreq(len(v), timestep)
            band = (f > min_frequency) & (f < max_frequency)
            total = power[band].sum()
            out.append((f[band] * power[band]).sum() / total if total > 0 else None)
        return pd.Series(out, dtype="float64")

    return series.select("atom_id", spectrum("speeds").alias("frequency"))


def average_vibrational_frequency(frames: DataFrame, **options) -> DataFrame:
    """One row: mean and population deviation of the atoms' frequencies."""
    return vibrational_frequencies(frames, **options).agg(F.avg("frequency").alias("mean"), F.stddev_pop("frequency").alias("deviation"))


def voronoi_sites(network: SiteNetwork, radii: DataFrame | None = None) -> SiteNetwork:
    """Sites at the Voronoi nodes of the static structure, their vertices the static atoms around; with radii the power diagram.

    A structure is small: its static atoms are handled in one task.
    """
    static = network.static_structure.select("static_idx", "x", "y", "z")
    if radii is not None:
        static = static.join(radii.select("static_idx", "radius"), "static_idx")
    matrix = network.cell.matrix

    def nodes(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values("static_idx")
        weights = rows["radius"].to_numpy() ** 2 if "radius" in rows else None
        at, around = voronoi_nodes(rows[["x", "y", "z"]].to_numpy(), matrix, weights)
        names = rows["static_idx"].to_numpy()
        yield pd.DataFrame({"site_id": np.arange(len(at), dtype="i4"), "cx": at[:, 0], "cy": at[:, 1], "cz": at[:, 2], "vertices": [names[a].tolist() for a in around]})

    found = static.coalesce(1).mapInPandas(nodes, "site_id int, cx double, cy double, cz double, vertices array<int>")
    return replace(network, sites=found, edges=None, computed=frozenset())
