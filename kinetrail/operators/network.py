"""Site networks: a property graph of sites in a periodic structure.

``atoms``  atom_id, atomic_number, symbol, mass, x, y, z, is_static, is_mobile, static_idx, mobile_idx
``sites``  site_id (dense from 0), cx, cy, cz, vertices array<int>, site_type, and attributes
``edges``  src, dst and attributes, sparse: an absent pair has the attribute's default

Networks are immutable; each method gives a new one.  Attributes remember
whether they were computed, so that a copy can leave computed ones out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Cell

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9_]*\Z")
_CORE = {"site_id", "cx", "cy", "cz", "vertices", "site_type", "src", "dst"}
#: What an absent edge means.
EDGE_DEFAULTS = {"n_ij": 0.0, "p_ij": 0.0, "jump_lag": float("inf"), "edge_diffusion_pathway": -1}


def index_atoms(atoms: DataFrame) -> DataFrame:
    """Adds the dense numbers of static and mobile atoms; an atom that is both raises when the result is read."""
    both = F.when(F.col("is_static") & F.col("is_mobile"), F.raise_error(F.lit("an atom is static and mobile"))).otherwise(F.col("is_static"))
    order = Window.orderBy("atom_id")  # a structure is small: thousands of atoms
    number = lambda flag: F.when(F.col(flag), (F.sum(F.col(flag).cast("int")).over(order) - 1).cast("int"))
    return atoms.withColumn("is_static", both).withColumns({"static_idx": number("is_static"), "mobile_idx": number("is_mobile")})


def dense(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds *new*: the rank of *old*, from 0, in a site-sized table."""
    return df.withColumn(new, (F.row_number().over(Window.orderBy(old)) - 1).cast("int"))


@dataclass(frozen=True)
class SiteNetwork:
    atoms: DataFrame
    cell: Cell
    sites: DataFrame | None = None
    edges: DataFrame | None = None
    computed: frozenset = field(default_factory=frozenset)

    # structure

    @property
    def static_structure(self) -> DataFrame:
        return self.atoms.where("is_static").orderBy("static_idx")

    @cached_property
    def n_mobile(self) -> int:
        return self.atoms.where("is_mobile").count()

    @cached_property
    def n_static(self) -> int:
        return self.atoms.where("is_static").count()

    @cached_property
    def n_total(self) -> int:
        return self.atoms.count()

    @cached_property
    def n_sites(self) -> int:
        return self.sites.count() if self.sites is not None else 0

    def __len__(self) -> int:
        return self.n_sites

    def structure_with_sites(self, atomic_number: int | None = None) -> DataFrame:
        """Static atoms, then the sites as atoms of the first mobile species (or *atomic_number*)."""
        first = self.atoms.where("is_mobile").orderBy("atom_id").limit(1).select(F.col("atomic_number").alias("__z"), F.col("symbol").alias("__s"))
        kind = (F.lit(atomic_number), F.lit(None).cast("string")) if atomic_number is not None else (F.col("__z"), F.col("__s"))
        sites = self.sites if atomic_number is not None else self.sites.crossJoin(F.broadcast(first))  # one row
        pseudo = sites.select(kind[0].alias("atomic_number"), kind[1].alias("symbol"), *(F.col(f"c{c}").alias(c) for c in "xyz"), F.lit(True).alias("is_site"))
        return self.atoms.where("is_static").select("atomic_number", "symbol", "x", "y", "z", F.lit(False).alias("is_site")).unionByName(pseudo)

    # sites and attributes

    @property
    def site_attributes(self) -> list[str]:
        return [c for c in self.sites.columns if c not in _CORE] if self.sites is not None else []

    @property
    def edge_attributes(self) -> list[str]:
        return [c for c in self.edges.columns if c not in _CORE] if self.edges is not None else []

    def has_attribute(self, name: str) -> bool:
        return name in self.site_attributes or name in self.edge_attributes

    def _check_name(self, name: str) -> None:
        if not _NAME.match(name):
            raise ValueError(f"not an attribute name: {name!r}")
        if name in _CORE or self.has_attribute(name) or hasattr(type(self), name) or name in self.__dataclass_fields__:
            raise KeyError(f"{name!r} is taken")

    def add_site_attribute(self, name: str, values: DataFrame, computed: bool = True, default: Column | None = None) -> SiteNetwork:
        """*values*: (site_id, name); sites without a value get the default, or null."""
        self._check_name(name)
        joined = self.sites.join(values.select("site_id", name), "site_id", "left")
        if default is not None:
            joined = joined.withColumn(name, F.coalesce(F.col(name), default))
        return replace(self, sites=joined, computed=self.computed | ({name} if computed else set()))

    def add_edge_attribute(self, name: str, values: DataFrame, computed: bool = True) -> SiteNetwork:
        """*values*: (src, dst, name), sparse."""
        self._check_name(name)
        new = values.select("src", "dst", name)
        edges = new if self.edges is None else self.edges.join(new, ["src", "dst"], "full")
        return replace(self, edges=edges, computed=self.computed | ({name} if computed else set()))

    def remove_attribute(self, name: str) -> SiteNetwork:
        if name in self.site_attributes:
            return replace(self, sites=self.sites.drop(name), computed=self.computed - {name})
        if name in self.edge_attributes:
            edges = self.edges.drop(name)
            return replace(self, edges=edges if len(edges.columns) > 2 else None, computed=self.computed - {name})
        raise AttributeError(f"no attribute {name!r}")

    def clear_attributes(self, only_computed: bool = False) -> SiteNetwork:
        out = self
        for name in [*self.site_attributes, *self.edge_attributes]:
            if not only_computed or name in self.computed:
                out = out.remove_attribute(name)
        return out

    def clear_computed_attributes(self) -> SiteNetwork:
        return self.clear_attributes(only_computed=True)

    def copy(self, with_computed: bool = True) -> SiteNetwork:
        return self if with_computed else self.clear_computed_attributes()

    def __getattr__(self, name: str):
        if name.startswith("_") or name in self.__dataclass_fields__:
            raise AttributeError(name)
        if name in self.site_attributes:
            return self.sites.select("site_id", name)
        if name in self.edge_attributes:
            return self.edges.select("src", "dst", name)
        raise AttributeError(name)

    def with_centers(self, centers: DataFrame) -> SiteNetwork:
        """New centers (site_id, cx, cy, cz): vertices, types and attributes are dropped, as they described the old ones."""
        return replace(self, sites=centers.select("site_id", "cx", "cy", "cz"), edges=None, computed=frozenset())

    def update_centers(self, centers: DataFrame) -> SiteNetwork:
        """Move the same sites; everything else stays."""
        rest = self.sites.drop("cx", "cy", "cz")
        return replace(self, sites=rest.join(centers.select("site_id", "cx", "cy", "cz"), "site_id"))

    @property
    def types(self) -> DataFrame:
        return self.sites.select("site_type").distinct().orderBy("site_type")

    @cached_property
    def n_types(self) -> int:
        return self.sites.agg(F.countDistinct("site_type")).first()[0]

    @property
    def number_of_vertices(self) -> DataFrame:
        return self.sites.select("site_id", F.size("vertices").alias("number_of_vertices"))

    def get_site(self, site: int) -> DataFrame:
        """All attributes of a site, one row."""
        return self.sites.where(F.col("site_id") == site)

    def get_edge(self, src: int, dst: int) -> DataFrame:
        """All attributes of an edge, one row, defaults for an absent one."""
        wanted = self.edges.sparkSession.createDataFrame([(src, dst)], "src int, dst int")
        row = wanted.join(self.edges, ["src", "dst"], "left")
        return row.fillna({c: v for c, v in EDGE_DEFAULTS.items() if c in row.columns})

    def subset(self, keep: DataFrame | Column) -> SiteNetwork:
        """The induced subgraph of the kept sites (a column predicate, or a table of site_id), renumbered densely."""
        chosen = self.sites.where(keep) if isinstance(keep, Column) else self.sites.join(keep.select("site_id"), "site_id", "left_semi")
        numbered = dense(chosen, "site_id", "__new")
        names = numbered.select("site_id", "__new")
        edges = self.edges
        if edges is not None:
            for end in ("src", "dst"):
                edges = edges.join(F.broadcast(names.select(F.col("site_id").alias(end), F.col("__new").alias(f"__{end}"))), end)
            edges = edges.select(F.col("__src").alias("src"), F.col("__dst").alias("dst"), *self.edge_attributes)
        sites = numbered.withColumn("site_id", F.col("__new")).drop("__new")
        return replace(self, sites=sites, edges=edges)

    def of_type(self, site_type: int) -> SiteNetwork:
        if "site_type" not in self.sites.columns:
            raise ValueError("the sites have no types")
        out = self.subset(F.col("site_type") == site_type)
        if not out.n_sites:
            raise ValueError(f"no site of type {site_type}")
        return out
