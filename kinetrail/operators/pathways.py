"""Diffusion pathways: sites joined by enough jumps, optionally only those that percolate."""

from __future__ import annotations

import numbers

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Cell, nearest_image, point, staged
from .graph import weak_components
from .network import SiteNetwork

NO_PATHWAY = -1


def connected_edges(counts: DataFrame, threshold: float = 1) -> DataFrame:
    """Edges with n_ij of at least the threshold; a non-integer threshold is a fraction of all jumps between sites."""
    if isinstance(threshold, numbers.Integral):
        return counts.where(F.col("n_ij") >= int(threshold))
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("src") != F.col("dst"), F.col("n_ij"))), F.lit(0.0)).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n_ij") >= F.lit(float(threshold)) * F.col("__total")).drop("__total")  # one row


def site_pathways(counts: DataFrame, sites: DataFrame, threshold: float = 1, minimum_n_sites: int = 0) -> DataFrame:
    """(site_id, pathway): weak components with enough sites, numbered by their smallest site; else -1."""
    found = weak_components(connected_edges(counts, threshold), sites.select("site_id"))
    return _numbered(found.withColumn("ok", F.count("*").over(Window.partitionBy("component")) >= minimum_n_sites))


def _numbered(found: DataFrame) -> DataFrame:
    """Dense pathway numbers of (site_id, component, ok)."""
    names = found.where("ok").select("component").distinct()
    names = names.withColumn("pathway", (F.row_number().over(Window.orderBy("component")) - 1).cast("int"))
    return found.join(names, "component", "left").select("site_id", F.when(F.col("ok"), F.col("pathway")).otherwise(NO_PATHWAY).alias("pathway"))


def periodic_edges(edges: DataFrame, sites: DataFrame, cell: Cell) -> DataFrame:
    """(src, dst, di, dj, dk): how many cells further the nearest image of dst lies than dst itself, seen from src."""
    wrapped = staged(sites, w=cell.wrap(point("cx", "cy", "cz")))
    at = lambda end: F.broadcast(wrapped.select(F.col("site_id").alias(end), *(F.col(f"w{n}").alias(f"{end}{n}") for n in "xyz")))
    joined = edges.select("src", "dst").where("src <> dst").join(at("src"), "src").join(at("dst"), "dst")
    found = nearest_image(joined, cell, point("srcx", "srcy", "srcz"), point("dstx", "dsty", "dstz"))
    code = found.select("src", "dst", F.col("image_code").alias("code"))
    return code.select("src", "dst", *((F.floor(F.col("code") / d).cast("int") % 10 - 1).alias(n) for d, n in ((100, "di"), (10, "dj"), (1, "dk"))))


def periodic_pathways(counts: DataFrame, sites: DataFrame, cell: Cell, threshold: float = 1) -> tuple[DataFrame, DataFrame]:
    """((site_id, pathway), (pathway, x, y, z)): percolating pathways and the directions they run in.

    Edges are laid out over 27 images of the cell.  A component percolates if
    it holds a site in two images and touches the central cell; percolating
    components that share sites are one pathway.  A direction tells along
    which axes the first two images of a repeated site differ.
    """
    edges = periodic_edges(connected_edges(counts, threshold), sites, cell)
    images = F.explode(F.array(*(F.struct(F.lit(i // 9 - 1).alias("i"), F.lit(i // 3 % 3 - 1).alias("j"), F.lit(i % 3 - 1).alias("k")) for i in range(27))))
    number = lambda s, i, j, k: (s.cast("long") * 27 + (i + 1) * 9 + (j + 1) * 3 + (k + 1)).cast("long")
    laid = edges.withColumn("at", images)
    to = [F.col("at")[a] + F.col(f"d{a}") for a in "ijk"]
    inside = (F.abs(to[0]) <= 1) & (F.abs(to[1]) <= 1) & (F.abs(to[2]) <= 1)
    super_edges = laid.where(inside).select(number(F.col("src"), *(F.col("at")[a] for a in "ijk")).alias("src"), number(F.col("dst"), *to).alias("dst"))
    nodes = sites.select(F.explode(F.sequence(F.col("site_id").cast("long") * 27, F.col("site_id").cast("long") * 27 + 26)).alias("node"))
    found = weak_components(super_edges, nodes, "node").withColumns({"site_id": F.floor(F.col("node") / 27).cast("int"), "image": (F.col("node") % 27).cast("int")})
    central = found.groupBy("component").agg(F.max((F.col("image") == 13).cast("int")).alias("c")).where("c = 1").select("component")
    members = found.join(central, "component").groupBy("component", "site_id").agg(F.sort_array(F.collect_set("image")).alias("images"))
    repeated = members.where(F.size("images") > 1)
    percolating = members.join(repeated.select("component").distinct(), "component", "left_semi")
    axis = lambda d: F.floor(F.element_at("images", 1) / d).cast("int") % 3 != F.floor(F.element_at("images", 2) / d).cast("int") % 3
    ways = repeated.select("component", axis(9).alias("x"), axis(3).alias("y"), axis(1).alias("z")).distinct()
    # Overlapping components are one: sites and components (numbered below zero) as one graph.
    links = percolating.select((-F.col("component") - 1).alias("src"), F.col("site_id").cast("long").alias("dst"))
    joint = links.select(F.col("src").alias("n")).union(links.select("dst")).distinct()
    merged = weak_components(links, joint, "n")
    smallest = merged.where("n >= 0").groupBy("component").agg(F.min("n").alias("first"))
    named = smallest.withColumn("pathway", (F.row_number().over(Window.orderBy("first")) - 1).cast("int"))
    of = merged.join(named, "component").select("n", "pathway")
    on_sites = sites.select("site_id").join(of.where("n >= 0").select(F.col("n").cast("int").alias("site_id"), "pathway"), "site_id", "left")
    directions = ways.join(of.where("n < 0").select((-F.col("n") - 1).alias("component"), "pathway"), "component").select("pathway", "x", "y", "z").distinct()
    return on_sites.select("site_id", F.coalesce("pathway", F.lit(NO_PATHWAY)).alias("pathway")), directions


def analyse_pathways(network: SiteNetwork, threshold: float = 1, periodic: bool = True, minimum_n_sites: int = 0) -> tuple[SiteNetwork, int, DataFrame | None]:
    """(network with site_diffusion_pathway and edge_diffusion_pathway, number of pathways, directions if periodic)."""
    if not network.has_attribute("n_ij"):
        raise ValueError("run the jump analysis first: the network has no n_ij")
    for name in ("site_diffusion_pathway", "edge_diffusion_pathway"):
        network = network.remove_attribute(name) if network.has_attribute(name) else network
    if periodic:
        found, directions = periodic_pathways(network.edges, network.sites, network.cell, threshold)
    else:
        found, directions = site_pathways(network.edges, network.sites, threshold, minimum_n_sites), None
    sites = found.withColumnRenamed("pathway", "site_diffusion_pathway")
    end = lambda e: found.where("pathway >= 0").select(F.col("site_id").alias(e), F.col("pathway").alias(f"p_{e}"))
    edges = end("src").join(end("dst"), F.col("p_src") == F.col("p_dst")).select("src", "dst", F.col("p_src").alias("edge_diffusion_pathway"))
    out = network.add_site_attribute("site_diffusion_pathway", sites).add_edge_attribute("edge_diffusion_pathway", edges)
    return out, found.where("pathway >= 0").select("pathway").distinct().count(), directions
