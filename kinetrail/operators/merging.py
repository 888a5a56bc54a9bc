"""Merging of sites: which sites belong together, and the trajectory over the merged ones.

A strategy gives ``groups``: (site_id, group), at most one group a site.
Merged sites are numbered by their smallest member; sites in no group vanish
and their assignments become unknown.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientSitesError, MergedSitesTooDistantError, MergeSitesError
from ..functions.geometry import Cell, near_pairs, periodic_mean, point
from ..plans.session import checkpointed
from .graph import markov_clusters, strong_components, weak_components
from .jump_statistics import analyse_jumps
from .trajectory import SiteTrajectory, occupancies, translate


def _centers(sites: DataFrame) -> DataFrame:
    return sites.select(F.col("site_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))


def merged_sites(sites: DataFrame, groups: DataFrame, cell: Cell, weights: DataFrame | None = None) -> DataFrame:
    """(site_id, cx, cy, cz, members[, vertices][, site_type]) of the merged sites.

    The center is the periodic mean of the members' centers, weighted by
    (site_id, weight) if given.
    """
    named = groups.groupBy("group").agg(F.min("site_id").alias("first"))
    named = named.withColumn("new_id", (F.row_number().over(Window.orderBy("first")) - 1).cast("int"))
    joined = sites.join(groups, "site_id").join(named, "group")
    points = joined.select("new_id", "site_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    if weights is not None:
        points = points.join(weights.select("site_id", "weight"), "site_id")
    mean = periodic_mean(points, cell, ["new_id"], ["site_id"], "weight" if weights is not None else None)
    rest = [F.sort_array(F.collect_list("site_id")).alias("members")]
    if "vertices" in sites.columns:
        rest.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("vertices")))).alias("vertices"))
    if "site_type" in sites.columns:
        rest.append(F.min("site_type").alias("site_type"))
    members = joined.groupBy("new_id").agg(*rest)
    return mean.select("new_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz")).join(members, "new_id").withColumnRenamed("new_id", "site_id")


@dataclass
class MergeSites:
    """Base: subclasses give :meth:`groups`."""

    check_types: bool = True
    maximum_merge_distance: float | None = None
    set_merged_into: bool = False
    weighted_spatial_average: bool = True
    legacy: bool = False  # weigh when not asked to, and the other way round

    def groups(self, st: SiteTrajectory) -> DataFrame:
        raise NotImplementedError

    def run(self, st: SiteTrajectory) -> SiteTrajectory:
        network = st.network
        if self.check_types and "site_type" not in network.sites.columns:
            raise ValueError("types are to be checked, but the sites have none")
        groups = checkpointed(self.groups(st))
        if groups.groupBy("site_id").agg(F.countDistinct("group").alias("n")).where("n > 1").limit(1).count():
            raise MergeSitesError("a site is in several groups")
        if self.check_types:
            mixed = network.sites.join(groups, "site_id").groupBy("group").agg(F.countDistinct("site_type").alias("n")).where("n > 1")
            if mixed.limit(1).count():
                raise MergeSitesError("a group has sites of several types")
        if self.maximum_merge_distance is not None:
            named = groups.withColumn("first", F.min("site_id").over(Window.partitionBy("group"))).where("site_id <> first")
            at = lambda k, n: network.sites.select(F.col("site_id").alias(k), *(F.col(f"c{c}").alias(f"{n}{c}") for c in "xyz"))
            far = named.join(at("first", "a"), "first").join(at("site_id", "b"), "site_id").where(network.cell.distance(point("ax", "ay", "az"), point("bx", "by", "bz")) > self.maximum_merge_distance)
            if far.limit(1).count():
                raise MergedSitesTooDistantError(f"sites farther than {self.maximum_merge_distance} from their group's first would be merged")
        n_new = groups.select("group").distinct().count()
        if n_new < network.n_mobile:
            raise InsufficientSitesError("merging", n_new, network.n_mobile)
        weights = None
        if self.weighted_spatial_average != self.legacy:
            weights = occupancies(st.assign, network.sites, st.n_frames).withColumnRenamed("occupancy", "weight")
        merged = merged_sites(network.sites, groups, network.cell, weights)
        mapping = merged.select(F.col("site_id").alias("new_id"), F.explode("members").alias("site_id"))
        new = replace(network, sites=merged.drop("members"), edges=None, computed=frozenset())
        out = replace(st, network=new, assign=translate(st.assign.drop("confidence"), mapping))
        if self.set_merged_into:
            into = mapping.withColumnRenamed("new_id", "merged_into")
            old = network.remove_attribute("merged_into") if network.has_attribute("merged_into") else network
            self.merged_from = old.add_site_attribute("merged_into", into, default=F.lit(-1))
        return out


def distance_filtered(edges: DataFrame, sites: DataFrame, cell: Cell, most: float) -> DataFrame:
    """Without edges between sites farther apart than *most*: a grid join gives the near pairs."""
    at = _centers(sites)
    near = near_pairs(at.withColumnRenamed("id", "id_a"), at.withColumnRenamed("id", "id_b"), cell, most).where("id_a < id_b")
    both = near.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).unionByName(near.select(F.col("id_b").alias("src"), F.col("id_a").alias("dst")))
    if most >= 0:
        both = both.unionByName(at.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    return edges.join(both, ["src", "dst"], "left_semi")


def co_occupied(assign: DataFrame) -> DataFrame:
    """(src, dst): ordered pairs of sites occupied in one frame, a site with itself included."""
    seen = assign.where(F.col("site") >= 0).select("frame", "site").distinct()
    per = seen.groupBy("frame").agg(F.collect_list("site").alias("held"))  # one row a frame, at most a site each
    return per.select(F.explode("held").alias("src"), "held").select("src", F.explode("held").alias("dst")).distinct()


@dataclass
class MergeSitesByThreshold(MergeSites):
    """Components of the pairs whose edge attribute compares as asked with the threshold."""

    attribute: str = "n_ij"
    threshold: float = 0
    relation: Callable[[Column, Column], Column] = operator.ge
    directed: bool = True
    connection: str = "strong"
    distance_threshold: float = float("inf")
    forbid_multiple_occupancy: bool = False
    default: float = 0.0

    def groups(self, st: SiteTrajectory) -> DataFrame:
        sites, edges = st.network.sites, st.network.edges
        if self.relation(self.default, self.threshold):  # absent pairs pass too: the dense table of sites
            n = sites.select(F.col("site_id").alias("src"))
            dense = n.crossJoin(F.broadcast(n.withColumnRenamed("src", "dst")))  # site-sized
            edges = dense.join(edges, ["src", "dst"], "left").fillna({self.attribute: self.default})
        kept = edges.where(self.relation(F.col(self.attribute), F.lit(self.threshold))).select("src", "dst")
        if self.distance_threshold < float("inf"):
            kept = distance_filtered(kept, sites, st.network.cell, self.distance_threshold)
        if self.forbid_multiple_occupancy:
            kept = kept.join(co_occupied(st.assign), ["src", "dst"], "left_anti")
        find = strong_components if self.directed and self.connection == "strong" else weak_components
        return find(kept, sites.select("site_id")).withColumnRenamed("component", "group")


def connectivity_n_ij(network) -> DataFrame:
    return network.edges.select("src", "dst", F.col("n_ij").alias("connectivity"))


def connectivity_jump_lag_biased(jump_lag_coeff: float = 1.0, jump_lag_sigma: float = 20.0, jump_lag_cutoff: float = float("inf"), distance_coeff: float = 0.5, distance_sigma: float = 1.0):
    """p_ij plus a Gaussian of the lag, times one plus a Gaussian of the distance (with their coefficients)."""

    def connectivity(network) -> DataFrame:
        at = lambda k: network.sites.select(F.col("site_id").alias(k), *(F.col(f"c{c}").alias(f"{k}{c}") for c in "xyz"))
        placed = network.edges.join(at("src"), "src").join(at("dst"), "dst")
        a, b = point("srcx", "srcy", "srcz"), point("dstx", "dsty", "dstz")
        apart = F.when(F.col("src") < F.col("dst"), network.cell.distance(a, b)).when(F.col("src") > F.col("dst"), network.cell.distance(b, a)).otherwise(0.0)
        lag = F.col("jump_lag")
        boost = F.when(lag.isNotNull() & (lag <= jump_lag_cutoff) & (lag < float("inf")), F.exp(-0.5 * F.pow((lag - 1) / jump_lag_sigma, 2))).otherwise(0.0)
        closeness = distance_coeff * F.exp(-0.5 * F.pow(F.col("distance") / distance_sigma, 2)) + (1 - distance_coeff)
        return placed.withColumn("distance", apart).select("src", "dst", ((F.coalesce("p_ij", F.lit(0.0)) + jump_lag_coeff * boost) * closeness).alias("connectivity"))

    return connectivity


@dataclass
class MergeSitesByDynamics(MergeSites):
    """Markov clusters of a connectivity between sites."""

    connectivity: Callable = connectivity_n_ij
    distance_threshold: float = 1.0
    post_check_factor: float | None = 1.5
    markov: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.maximum_merge_distance is None and self.post_check_factor is not None:
            self.maximum_merge_distance = self.post_check_factor * self.distance_threshold

    def groups(self, st: SiteTrajectory) -> DataFrame:
        if not st.network.has_attribute("n_ij"):
            st = analyse_jumps(st)
        kept = distance_filtered(self.connectivity(st.network), st.network.sites, st.network.cell, self.distance_threshold)
        return markov_clusters(kept, st.network.sites, "connectivity", **self.markov).withColumnRenamed("cluster", "group")


def alarming_edges(edges: DataFrame, value: str, n_sites: int) -> DataFrame:
    """One row, threshold: mean plus three deviations of all pairs of different sites, absent ones as 0."""
    off = edges.where("src <> dst")
    n = float(n_sites * (n_sites - 1))
    sums = off.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col(value) * F.col(value)), F.lit(0.0)).alias("q"))
    return sums.select((F.col("s") / n + 3 * F.sqrt(F.greatest(F.col("q") / n - F.pow(F.col("s") / n, 2), F.lit(0.0)))).alias("threshold"))


def lennard_jones(images: DataFrame, statics: DataFrame, cell: Cell, epsilon: float = 1.0, sigma: float = 1.0, cutoff: float = 5.0) -> DataFrame:
    """(i, j, image, energy) of one particle at (x, y, z) among the static atoms, by a join within the cutoff."""
    at = images.select("i", "j", "image", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    atoms = F.broadcast(statics.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz")))  # the structure's static atoms
    r = cell.distance(point("ax", "ay", "az"), point("bx", "by", "bz"))
    s6 = F.pow(F.lit(sigma) / F.greatest(F.col("r"), F.lit(1e-3)), 6)
    near = at.join(atoms, r <= cutoff, "left").withColumn("r", r)
    return near.groupBy("i", "j", "image").agg(F.coalesce(F.sum(4 * epsilon * (s6 * s6 - s6)), F.lit(0.0)).alias("energy"))


def driven_images(pairs: DataFrame, sites: DataFrame, cell: Cell, n: int) -> DataFrame:
    """(i, j, image, x, y, z): n points on the line from i to the nearest image of j."""
    at = lambda k: F.broadcast(sites.select(F.col("site_id").alias(k), *(F.col(f"c{c}").alias(f"{k}{c}") for c in "xyz")))
    joined = pairs.join(at("i"), "i").join(at("j"), "j").withColumn("q", cell.min_image(point("ix", "iy", "iz"), point("jx", "jy", "jz")))
    image = joined.withColumn("image", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    c = F.col("image") / F.lit(float(n - 1))
    return image.select("i", "j", "image", *((F.col(f"i{a}") + c * (F.col("q")[a] - F.col(f"i{a}"))).alias(a) for a in "xyz"))


@dataclass
class MergeSitesByBarrier(MergeSites):
    """Sites that jumps join and no energy barrier above the threshold parts.

    ``energy(images, statics, cell)`` gives (i, j, image, energy).
    """

    energy: Callable = lennard_jones
    barrier_threshold: float = 1.0
    n_driven_images: int = 20
    maximum_pairwise_distance: float = 2.0
    minimum_jumps: float = 1

    def groups(self, st: SiteTrajectory) -> DataFrame:
        if not st.network.has_attribute("n_ij"):
            st = analyse_jumps(st)
        network, ok = st.network, mergeable_pairs
        kept = ok(network.edges, network.sites, network.static_structure, network.cell, self.energy, self.barrier_threshold, self.n_driven_images, self.maximum_pairwise_distance, self.minimum_jumps)
        return strong_components(kept, network.sites.select("site_id")).withColumnRenamed("component", "group")


def mergeable_pairs(edges, sites, statics, cell, energy=lennard_jones, barrier=1.0, n_images=20, most_distant=2.0, least_jumps=1) -> DataFrame:
    """(src, dst) that may merge: near, with enough jumps, and no barrier over the threshold from src to dst."""
    if n_images < 3:
        raise ValueError("a barrier needs an initial, a transition and a final image")
    near = distance_filtered(edges.where((F.col("n_ij") >= least_jumps) & (F.col("src") != F.col("dst"))).select("src", "dst"), sites, cell, most_distant)
    pairs = near.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    e = energy(driven_images(pairs, sites, cell, n_images), statics, cell)
    top = e.groupBy("i", "j").agg(
        F.max(F.struct("energy", (-F.col("image")).alias("m"))).alias("top"),
        F.min_by("energy", "image").alias("first"),
        F.max_by("energy", "image").alias("last"),
    )
    peak = -F.col("top")["m"]
    inner = (peak != 0) & (peak != n_images - 1)
    judged = top.select("i", "j", inner.alias("inner"), (F.col("top")["energy"] - F.col("first") <= barrier).alias("forward"), (F.col("top")["energy"] - F.col("last") <= barrier).alias("backward"))
    forward = judged.where("inner and forward").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    backward = judged.where("inner and backward").select(F.col("j").alias("src"), F.col("i").alias("dst"))
    flat = judged.where("not inner").select("i", "j")
    both = flat.select(F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(flat.select(F.col("j").alias("src"), F.col("i").alias("dst")))
    return forward.unionByName(backward).unionByName(both.join(near, ["src", "dst"], "left_semi"))
