"""Jump statistics of a site trajectory: transition counts, lags, residence times.

A frame counts once for a pair of sites (or a site), however many particles
make the transition (``count_rows=True`` counts each).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import effective
from .trajectory import SiteTrajectory


def transition_counts(eff: DataFrame, count_rows: bool = False) -> DataFrame:
    """(src, dst, n_ij) with self-transitions."""
    n = F.count("*") if count_rows else F.countDistinct("frame")
    return eff.where("both_known").groupBy(F.col("last_known").alias("src"), F.col("effective").alias("dst")).agg(n.cast("double").alias("n_ij"))


def corrected_residences(eff: DataFrame, count_rows: bool = False) -> DataFrame:
    """(site_id, total_corrected_residences): frames at a site, unknowns filled by the last known."""
    n = F.count("*") if count_rows else F.countDistinct("frame")
    return eff.where("both_known").groupBy(F.col("effective").alias("site_id")).agg(n.alias("total_corrected_residences"))


def jump_lags(eff: DataFrame, count_rows: bool = False) -> DataFrame:
    """(src, dst, jump_lag): mean time before a jump; of several in a frame the highest particle's counts."""
    moved = eff.where("jumped").select(F.col("last_known").alias("src"), F.col("effective").alias("dst"), "frame", "mobile", "lag")
    if not count_rows:
        moved = moved.groupBy("frame", "src", "dst").agg(F.max_by("lag", "mobile").alias("lag"))
    return moved.groupBy("src", "dst").agg(F.avg("lag").alias("jump_lag"))


def transitions(eff: DataFrame) -> DataFrame:
    """(src, dst, n_ij, jump_lag): both statistics of each pair by one aggregate per frame and one over frames."""
    moves = eff.where("both_known").select("frame", F.col("last_known").alias("src"), F.col("effective").alias("dst"), "mobile", "lag")
    frames = moves.groupBy("frame", "src", "dst").agg(F.max_by("lag", "mobile").alias("lag"))
    return frames.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n_ij"), F.avg(F.when(F.col("src") != F.col("dst"), F.col("lag"))).alias("jump_lag"))


def edge_statistics(eff: DataFrame, legacy: bool = False) -> DataFrame:
    """(src, dst, n_ij, p_ij, jump_lag). p_ij divides by the time at src; *legacy* divides by the time at dst."""
    by = "dst" if legacy else "src"
    time = corrected_residences(eff).select(F.col("site_id").alias(by), F.col("total_corrected_residences").alias("__t"))
    return transitions(eff).join(time, by, "left").select("src", "dst", "n_ij", (F.col("n_ij") / F.col("__t")).alias("p_ij"), "jump_lag")


def residence_times(lags: DataFrame, sites: DataFrame, n_frames: int) -> DataFrame:
    """(site_id, residence_time): unweighted mean of a site's jump lags; all frames if it has none."""
    mean = lags.where("jump_lag is not null").groupBy(F.col("src").alias("site_id")).agg(F.avg("jump_lag").alias("m"))
    return sites.select("site_id").join(mean, "site_id", "left").select("site_id", F.coalesce("m", F.lit(float(n_frames))).alias("residence_time"))


def occupancy_frequencies(counts: DataFrame, sites: DataFrame, n_frames: int) -> DataFrame:
    """(site_id, occupancy_freq): transitions into a site per frame."""
    into = counts.groupBy(F.col("dst").alias("site_id")).agg(F.sum("n_ij").alias("n"))
    return sites.select("site_id").join(into, "site_id", "left").select("site_id", (F.coalesce("n", F.lit(0.0)) / F.lit(n_frames)).alias("occupancy_freq"))


def jump_lag_by_type(lags: DataFrame, sites: DataFrame) -> DataFrame:
    """(type_from, type_to, jump_lag, n_pairs) of all pairs of types: mean over site pairs with jumps, null without."""
    kind = lambda end: F.broadcast(sites.select(F.col("site_id").alias(end), F.col("site_type").alias(f"type_{'from' if end == 'src' else 'to'}")))
    found = lags.where("jump_lag is not null").join(kind("src"), "src").join(kind("dst"), "dst").groupBy("type_from", "type_to").agg(F.avg("jump_lag").alias("jump_lag"), F.count("*").alias("n_pairs"))
    types = sites.agg(F.array_sort(F.collect_set("site_type")).alias("t"))  # one row: the few types
    spine = types.select(F.explode("t").alias("type_from"), "t").select("type_from", F.explode("t").alias("type_to"))
    return spine.join(found, ["type_from", "type_to"], "left").select("type_from", "type_to", "jump_lag", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))


def analyse_jumps(st: SiteTrajectory, legacy: bool = False) -> SiteTrajectory:
    """The trajectory with its network's n_ij, p_ij, jump_lag, residence_time, occupancy_freq and total_corrected_residences."""
    network = st.network
    for name in ("n_ij", "p_ij", "jump_lag", "residence_time", "occupancy_freq", "total_corrected_residences"):
        if network.has_attribute(name):
            network = network.remove_attribute(name)
    eff = effective(st.assign)
    edges = edge_statistics(eff, legacy)
    for name in ("n_ij", "p_ij", "jump_lag"):
        network = network.add_edge_attribute(name, edges)
    network = network.add_site_attribute("residence_time", residence_times(edges, network.sites, st.n_frames))
    network = network.add_site_attribute("occupancy_freq", occupancy_frequencies(edges, network.sites, st.n_frames))
    network = network.add_site_attribute("total_corrected_residences", corrected_residences(eff), default=F.lit(0).cast("long"))
    return replace(st, network=network)


def plot_lags(edges: DataFrame, least_events: float = 1) -> DataFrame:
    """Edges with enough jumps for a plot of lags."""
    return edges.where((F.col("n_ij") >= least_events) & (F.col("src") != F.col("dst"))).select("src", "dst", "jump_lag", "n_ij")


def configurational_entropy(residences: DataFrame, sites: DataFrame, n_frames: int, overshoot: float = 1e-3) -> DataFrame:
    """One row, entropy: -sum N (p ln p + (1-p) ln (1-p)) / sum n over types (sites without types).

    p = n / N with n the corrected residences per frame; p above 1 by less
    than *overshoot* is 1, by more raises; p of 0 and 1 add nothing.
    """
    typed = "site_type" in sites.columns
    key = F.col("site_type") if typed else F.col("site_id")
    joined = sites.join(residences.select("site_id", "total_corrected_residences"), "site_id", "left")
    per = joined.groupBy(key.alias("kind")).agg(F.count("*").cast("double").alias("size"), (F.sum(F.coalesce("total_corrected_residences", F.lit(0))) / F.lit(n_frames)).alias("n"))
    raw = F.col("n") / F.col("size")
    p = F.when(raw <= 1, raw).when(raw - 1 < overshoot, F.lit(1.0)).otherwise(F.raise_error(F.concat(F.lit("more than fully occupied: "), F.col("kind").cast("string"))).cast("double"))
    q = per.withColumn("p", p)
    term = F.when((F.col("p") == 0) | (F.col("p") == 1), 0.0).otherwise(F.col("size") * (F.col("p") * F.log("p") + (1 - F.col("p")) * F.log(1 - F.col("p"))))
    return q.agg((-F.sum(term) / F.sum("n")).alias("entropy"))
