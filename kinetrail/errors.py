"""Errors of the analyses."""


class SiteAnalysisError(Exception):
    """Base of all errors of this package."""


class MultipleOccupancyError(SiteAnalysisError):
    """More mobile particles share a site in one frame than is allowed."""

    def __init__(self, mobile: list, site: int, frame: int):
        super().__init__(f"mobile particles {mobile} are all at site {site} in frame {frame}")
        self.mobile, self.site, self.frame = mobile, site, frame


class InsufficientSitesError(SiteAnalysisError):
    """Fewer sites than mobile particles would be left."""

    def __init__(self, verb: str, n_sites: int, n_mobile: int):
        super().__init__(f"{verb} leaves {n_sites} sites for {n_mobile} mobile particles")
        self.n_sites, self.n_mobile = n_sites, n_mobile


class LandmarkAnalysisError(SiteAnalysisError):
    """Base of the landmark pipeline's errors."""


class StaticLatticeError(LandmarkAnalysisError):
    """Static atoms cannot be matched with the lattice in some frame."""

    def __init__(self, lattice_points: list, frame: int, why: str = "moved too far"):
        super().__init__(f"static lattice points {lattice_points} in frame {frame}: {why}")
        self.lattice_points, self.frame = lattice_points, frame


class ZeroLandmarkError(LandmarkAnalysisError):
    """A mobile particle is near no landmark in some frame."""

    def __init__(self, mobile: int, frame: int):
        super().__init__(f"mobile particle {mobile} has no landmark in frame {frame}")
        self.mobile, self.frame = mobile, frame


class MergeSitesError(SiteAnalysisError):
    """Sites cannot be merged as asked."""


class MergedSitesTooDistantError(MergeSitesError):
    """A group to merge has members too far from its first."""


class InsufficientCoordinatingAtomsError(SiteAnalysisError):
    """A site has too few vertices to enclose a volume."""
