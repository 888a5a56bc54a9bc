"""Site trajectories: the fact table of (frame, mobile, site[, confidence]) and its network."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientSitesError, MultipleOccupancyError
from . import series
from .network import SiteNetwork

UNKNOWN = series.UNKNOWN


def from_matrix(wide: DataFrame, frame: str = "frame", sites: str = "sites", confidences: str | None = None) -> DataFrame:
    """Rows of a frame with an array over particles to (frame, mobile, site[, confidence])."""
    zipped = F.arrays_zip(F.col(sites).alias("site"), *([F.col(confidences).alias("confidence")] if confidences else []))
    out = wide.select(F.col(frame).cast("long").alias("frame"), F.posexplode(zipped).alias("mobile", "z"))
    return out.select("frame", F.col("mobile").cast("long").alias("mobile"), "z.*")


def occupancies(assign: DataFrame, sites: DataFrame, n_frames: int) -> DataFrame:
    """(site_id, occupancy): particle-frames of each site per frame; 0 for sites never seen."""
    seen = assign.where(F.col("site") >= 0).groupBy(F.col("site").alias("site_id")).count()
    return sites.select("site_id").join(seen, "site_id", "left").select("site_id", (F.coalesce("count", F.lit(0)) / F.lit(n_frames)).alias("occupancy"))


def unassigned(assign: DataFrame) -> DataFrame:
    """One row: n_unassigned, n_assigned and fraction_unassigned."""
    return assign.agg(F.count_if(F.col("site") < 0).alias("n_unassigned"), F.count_if(F.col("site") >= 0).alias("n_assigned"), F.avg((F.col("site") < 0).cast("double")).alias("fraction_unassigned"))


def shared_sites(assign: DataFrame) -> DataFrame:
    """(frame, site, n): how many particles are at each occupied site in each frame."""
    return assign.where(F.col("site") >= 0).groupBy("frame", "site").agg(F.count("*").alias("n"))


def multiple_occupancy(assign: DataFrame) -> DataFrame:
    """One row: n_multiple (frame-sites with several particles) and mean particles of an occupied frame-site."""
    return shared_sites(assign).agg(F.count_if(F.col("n") > 1).alias("n_multiple"), F.avg("n").alias("mean_occupancy"))


def unoccupied_translation(assign: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, new_id): the sites ever seen, renumbered densely."""
    seen = sites.select("site_id").join(assign.select(F.col("site").alias("site_id")).distinct(), "site_id", "left_semi")
    return seen.withColumn("new_id", (F.row_number().over(Window.orderBy("site_id")) - 1).cast("int"))


def translate(assign: DataFrame, mapping: DataFrame, old: str = "site_id", new: str = "new_id") -> DataFrame:
    """Renumber the site column; sites without a new number, and unknowns, are unknown."""
    names = mapping.select(F.col(old).alias("site"), F.col(new).alias("__new"))
    return assign.join(names, "site", "left").withColumn("site", F.coalesce("__new", F.lit(UNKNOWN)).cast("int")).select(*assign.columns)


@dataclass(frozen=True)
class SiteTrajectory:
    network: SiteNetwork
    assign: DataFrame
    frames: DataFrame | None = None  # (frame, atom_id, x, y, z)

    @cached_property
    def n_frames(self) -> int:
        return self.assign.agg(F.countDistinct("frame")).first()[0]

    def __len__(self) -> int:
        return self.n_frames

    def with_network(self, network: SiteNetwork) -> SiteTrajectory:
        """Another network of the same structure."""
        masks = [n.atoms.select("atom_id", "is_static", "is_mobile") for n in (self.network, network)]
        if masks[0].exceptAll(masks[1]).limit(1).count() or masks[1].exceptAll(masks[0]).limit(1).count():
            raise ValueError("the networks' static and mobile masks differ")
        return replace(self, network=network)

    def with_frames(self, frames: DataFrame) -> SiteTrajectory:
        """Attach real positions; every frame needs every atom."""
        n, frames_there = frames.agg(F.count("*"), F.countDistinct("frame")).first()
        if frames_there != self.n_frames or n != frames_there * self.network.n_total:
            raise ValueError("the positions do not match the assignments' frames and the structure's atoms")
        return replace(self, frames=frames)

    def without_frames(self) -> SiteTrajectory:
        return replace(self, frames=None)

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> SiteTrajectory:
        """Frames start, start + step, ... below stop, renumbered from 0."""
        start = start or 0
        keep = (F.col("frame") >= start) & ((F.col("frame") - start) % step == 0)
        if stop is not None:
            keep &= F.col("frame") < stop
        cut = lambda df: df and df.where(keep).withColumn("frame", ((F.col("frame") - start) / step).cast("long"))
        return replace(self, assign=cut(self.assign), frames=cut(self.frames))

    def particle(self, mobile: int) -> DataFrame:
        return self.assign.where(F.col("mobile") == mobile).orderBy("frame")

    def positions(self) -> DataFrame:
        """Assignments with the particle's real position: an equi-join on frame and atom."""
        if self.frames is None:
            raise ValueError("no real positions are attached")
        mobile = self.network.atoms.where("is_mobile").select("atom_id", F.col("mobile_idx").alias("mobile"))
        return self.assign.join(F.broadcast(mobile), "mobile").join(self.frames.select("frame", "atom_id", "x", "y", "z"), ["frame", "atom_id"])

    def positions_for_site(self, site: int) -> DataFrame:
        return self.positions().where(F.col("site") == site).orderBy("frame", "mobile")

    def with_occupancies(self) -> SiteTrajectory:
        network = self.network.remove_attribute("occupancy") if self.network.has_attribute("occupancy") else self.network
        return replace(self, network=network.add_site_attribute("occupancy", occupancies(self.assign, network.sites, self.n_frames)))

    def check_multiple_occupancy(self, most: int = 1) -> tuple[int, float]:
        """(frame-sites with several particles, mean particles of an occupied one); raises at the first over *most*."""
        shared = shared_sites(self.assign)
        first = shared.where(F.col("n") > most).orderBy("frame", "site").limit(1).collect()
        if first:
            frame, site = first[0].frame, first[0].site
            mobile = [r.mobile for r in self.assign.where((F.col("frame") == frame) & (F.col("site") == site)).orderBy("mobile").select("mobile").limit(100).collect()]
            raise MultipleOccupancyError(mobile, site, frame)
        row = multiple_occupancy(self.assign).first()
        return row.n_multiple, row.mean_occupancy

    def remove_unoccupied(self) -> SiteTrajectory:
        """Without the sites never seen; attributes stay, confidences do not."""
        mapping = unoccupied_translation(self.assign, self.network.sites)
        kept = mapping.count()
        if kept == self.network.n_sites:
            return self
        if kept < self.network.n_mobile:
            raise InsufficientSitesError("removing unoccupied sites", kept, self.network.n_mobile)
        return replace(self, network=self.network.subset(mapping), assign=translate(self.assign.drop("confidence"), mapping))

    def assign_to_last_known(self, frame_threshold: int = 1) -> SiteTrajectory:
        return replace(self, assign=series.assign_to_last_known(self.assign, frame_threshold))

    def smooth(self, threshold: int, window_factor: float = 2.1, remove_unoccupied: bool = True, set_unassigned: bool = True) -> SiteTrajectory:
        out = replace(self, assign=series.rolling_mode(self.assign, threshold, window_factor, set_unassigned))
        out = out.remove_unoccupied() if remove_unoccupied else out
        return replace(out, network=out.network.clear_attributes())

    def jumps(self, unknown_as_jump: bool = False) -> DataFrame:
        return series.jumps(self.assign, unknown_as_jump)

    def jumps_by_frame(self, unknown_as_jump: bool = False) -> DataFrame:
        return series.jumps_by_frame(self.assign, unknown_as_jump)
