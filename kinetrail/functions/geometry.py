"""Periodic geometry as column expressions.

A point is three double columns, so that everything stays within whole-stage
code generation; the cell is a 3x3 list whose rows are the cell vectors and
enters as literals.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(*names: str) -> Point:
    """Columns of the given names as a point."""
    return tuple(F.col(n) for n in names)


def staged(df: DataFrame, **points: Point) -> DataFrame:
    """Adds points as columns (name + x, y, z): what is used many times in an expression is then computed once a row."""
    return df.withColumns({f"{name}{c}": v for name, p in points.items() for c, v in zip("xyz", p)})


def norm(p: Point) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


def minus(p: Point, q: Point) -> Point:
    return tuple(a - b for a, b in zip(p, q))


def plus(p: Point, q: Point) -> Point:
    return tuple(a + b for a, b in zip(p, q))


@dataclass(frozen=True)
class Cell:
    """A periodic cell; ``rows`` are its vectors."""

    rows: tuple[tuple[float, float, float], ...]

    @classmethod
    def of(cls, rows) -> Cell:
        return cls(tuple(tuple(float(x) for x in r) for r in rows))

    @cached_property
    def matrix(self) -> np.ndarray:
        return np.array(self.rows)

    @cached_property
    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.matrix)

    @cached_property
    def centroid(self) -> np.ndarray:
        return 0.5 * self.matrix.sum(0)

    @property
    def center(self) -> Point:
        return tuple(F.lit(float(x)) for x in self.centroid)

    @staticmethod
    def _apply(p: Point, m: np.ndarray) -> Point:
        """The row vector p times a matrix."""
        return tuple(sum((p[i] * F.lit(float(m[i, j])) for i in range(1, 3)), p[0] * F.lit(float(m[0, j]))) for j in range(3))

    def fractional(self, p: Point) -> Point:
        return self._apply(p, self.inverse)

    def cartesian(self, f: Point) -> Point:
        return self._apply(f, self.matrix)

    def wrap(self, p: Point) -> Point:
        """The periodic image in the cell, fractional parts in [0, 1)."""
        return self.cartesian(tuple(f - F.floor(f) for f in self.fractional(p)))

    def contains(self, p: Point) -> Column:
        inside = [(f >= 0) & (f < 1) for f in self.fractional(p)]
        return inside[0] & inside[1] & inside[2]

    def image(self, p: Point) -> Point:
        """Which image of the cell a point lies in: floors of its fractional coordinates."""
        return tuple(F.floor(f).cast("int") for f in self.fractional(p))

    def recentred(self, p: Point, on: Point) -> Point:
        """p, shifted so that *on* is at the centroid, wrapped."""
        return self.wrap(tuple(a - b + c for a, b, c in zip(p, on, self.center)))

    def distance(self, p: Point, q: Point) -> Column:
        """Distance after p is moved to the centroid and q wrapped; not the minimum image in strongly skewed cells."""
        return norm(minus(self.recentred(q, p), self.center))

    def min_image(self, reference: Point, p: Point) -> Column:
        """struct(distance, code, x, y, z): the nearest of p's 27 images about its own cell.

        The code has a digit 0, 1, 2 for each axis (111: p itself); of equally
        near images the smallest code wins. Both points should be in one cell.
        """
        found = []
        for i in range(27):
            shift = np.array([i // 9, i // 3 % 3, i % 3]) - 1
            q = tuple(a + F.lit(float(x)) for a, x in zip(p, shift @ self.matrix))
            found.append(F.struct(norm(minus(q, reference)).alias("distance"), F.lit(100 * (i // 9) + 10 * (i // 3 % 3) + i % 3).alias("code"), *(c.alias(n) for c, n in zip(q, "xyz"))))
        return F.array_min(F.array(*found))

    # numpy forms, for kernels and small tables on the driver

    def wrap_array(self, p: np.ndarray) -> np.ndarray:
        f = p @ self.inverse
        return (f - np.floor(f)) @ self.matrix

    def distances_array(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.wrap_array(q - p + self.centroid) - self.centroid, axis=-1)


def nearest_image(df: DataFrame, cell: Cell, reference: Point, p: Point, name: str = "image") -> DataFrame:
    """Adds name_code, name_x, name_y, name_z and name_distance as :meth:`Cell.min_image` has them, column by column.

    |d + s|^2 = |d|^2 + 2 d.s + |s|^2, so that the 27 shifts s are compared by
    sums of three products and a constant; generated code stays small enough
    to be compiled.  Squares that agree to eight decimals count as equal.
    """
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    out = staged(staged(df, __p=p, __q=reference), __d=minus(p, reference))
    d = point("__dx", "__dy", "__dz")
    out = staged(out, __a=tuple(2.0 * (d[0] * r[0] + d[1] * r[1] + d[2] * r[2]) for r in cell.rows))
    along, gains = point("__ax", "__ay", "__az"), []
    for s in steps:
        total = F.lit(float(((np.array(s) @ cell.matrix) ** 2).sum()))
        for n, a in zip(s, along):
            total = total + a if n > 0 else total - a if n < 0 else total
        gains.append(F.struct(F.floor(total * 1e8 + 0.5).alias("gain"), F.lit(100 * (s[0] + 1) + 10 * (s[1] + 1) + s[2] + 1).alias("code")))
    out = out.withColumn(f"{name}_code", F.array_min(F.array(*gains))["code"])
    code = F.col(f"{name}_code")
    out = out.withColumns({f"__{k}": (v % 10 - 1).cast("double") for k, v in (("i", F.floor(code / 100)), ("j", F.floor(code / 10)), ("k", code))})
    at = {f"{name}_{c}": F.col(f"__p{c}") + sum((F.col(f"__{k}") * cell.rows[n][m] for n, k in ((1, "j"), (2, "k"))), F.col("__i") * cell.rows[0][m]) for m, c in enumerate("xyz")}
    out = out.withColumns(at)
    far = norm(minus(point(*at), point("__qx", "__qy", "__qz")))
    return out.withColumn(f"{name}_distance", far).drop(*(f"__{t}{c}" for t in "pqda" for c in "xyz"), "__i", "__j", "__k")


def pairwise_distances(points: DataFrame, cell: Cell, id_col: str = "id") -> DataFrame:
    """(i, j, distance) of all ordered pairs of a small table of points (sites); the diagonal is 0.

    The half i < j is computed by a self-join on the order and mirrored.
    """
    a = points.select(F.col(id_col).alias("i"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = points.select(F.col(id_col).alias("j"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    half = a.join(b, F.col("i") < F.col("j")).select("i", "j", cell.distance(point("ax", "ay", "az"), point("bx", "by", "bz")).alias("distance"))
    mirror = half.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")
    return half.unionByName(mirror).unionByName(points.select(F.col(id_col).alias("i"), F.col(id_col).alias("j"), F.lit(0.0).alias("distance")))


def near_pairs(a: DataFrame, b: DataFrame, cell: Cell, cutoff: float, on: list[str] | None = None) -> DataFrame:
    """Rows of *a* (id_a, x, y, z) and *b* (id_b, x, y, z) nearer than *cutoff*, by a grid join.

    Both sides are wrapped and binned by fractional coordinates into bins no
    thinner than the cutoff; *b* goes to its bin's neighbours, so the join is
    an equi-join on the bin (and *on*, e.g. the frame).  Cells thinner than
    three bins along an axis use one bin there.
    """
    on = on or []
    heights = 1 / np.linalg.norm(cell.inverse, axis=0)
    bins = [int(h // cutoff) if cutoff > 0 and h // cutoff >= 3 else 1 for h in heights]

    def binned(df: DataFrame, tag: str) -> DataFrame:
        f = cell.fractional(cell.wrap(point("x", "y", "z")))
        cols = [F.least(F.floor(x * n), F.lit(n - 1)).cast("int").alias(f"bin{k}") for k, (x, n) in enumerate(zip(f, bins))]
        return df.select(*on, f"id_{tag}", *(F.col(c).alias(f"{tag}{c}") for c in "xyz"), *cols)

    left, right = binned(a, "a"), binned(b, "b")
    for k, n in enumerate(bins):
        if n > 1:
            right = right.withColumn(f"bin{k}", F.explode(F.array(*(F.pmod(F.col(f"bin{k}") + s, F.lit(n)).cast("int") for s in (-1, 0, 1)))))
    joined = left.join(right, [*on, "bin0", "bin1", "bin2"])
    return joined.select(*on, "id_a", "id_b", cell.distance(point("ax", "ay", "az"), point("bx", "by", "bz")).alias("distance")).where(F.col("distance") <= cutoff)


def periodic_mean(points: DataFrame, cell: Cell, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """Periodic mean of the points (x, y, z) of each group: (keys, x, y, z, n).

    Points are recentred on the group's first point (with a weight: the first
    of the heaviest), averaged, moved back and wrapped. Two pre-aggregated
    passes, so a large group is never gathered in one task.
    """
    xyz = F.struct("x", "y", "z")
    rank = F.struct(*([-F.col(weight)] if weight else []), *(F.col(c) for c in order))
    pivots = points.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), xyz.alias("pivot")))["pivot"].alias("pivot"))
    pivot = tuple(F.col("pivot")[c] for c in "xyz")
    moved = points.join(pivots, keys).withColumn("q", F.struct(*(c.alias(n) for c, n in zip(cell.recentred(point("x", "y", "z"), pivot), "xyz"))))
    w = F.col(weight) if weight else F.lit(1.0)
    sums = moved.groupBy(*keys).agg(F.first("pivot").alias("pivot"), *((F.sum(w * F.col("q")[c]) / F.sum(w)).alias(c) for c in "xyz"), F.count("*").alias("n"))
    back = cell.wrap(tuple(F.col(c) - m + p for c, m, p in zip("xyz", cell.center, pivot)))
    return sums.select(*keys, *(c.alias(n) for c, n in zip(back, "xyz")), "n")


def time_average(frames: DataFrame, cell: Cell) -> DataFrame:
    """(atom_id, x, y, z): periodic mean of each atom's positions, recentred on its first frame."""
    return periodic_mean(frames, cell, ["atom_id"], ["frame"]).drop("n")


def recenter(frames: DataFrame, atoms: DataFrame, cell: Cell, mass: str = "mass", velocities: bool = False) -> DataFrame:
    """Move the static atoms' centre of mass of each frame to the centroid.

    With *velocities* (columns vx, vy, vz) the static drift is removed from
    them, without a shift.  *atoms* has atom_id, is_static and the mass.
    """
    static = frames.join(F.broadcast(atoms.where("is_static").select("atom_id", F.col(mass).alias("__m"))), "atom_id")
    names = ["x", "y", "z", *(["vx", "vy", "vz"] if velocities else [])]
    drift = static.groupBy("frame").agg(*((F.sum(F.col("__m") * F.col(c)) / F.sum("__m")).alias(f"__{c}") for c in names))
    center = dict(zip("xyz", cell.centroid))
    moved = {c: F.col(c) - F.col(f"__{c}") + F.lit(float(center.get(c, 0.0))) for c in names}
    return frames.join(drift, "frame").withColumns(moved).drop(*(f"__{c}" for c in names))
