"""Networks and trajectories as Parquet: one directory per table, the cell and attribute lineage beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Cell
from ..operators.network import SiteNetwork, index_atoms
from ..operators.trajectory import SiteTrajectory

ATOMS = "atom_id int, atomic_number int, symbol string, mass double, x double, y double, z double, is_static boolean, is_mobile boolean"


def network_from_rows(spark: SparkSession, atoms, cell, sites=None) -> SiteNetwork:
    """A network from Python rows: atoms by :data:`ATOMS`, sites as (site_id, cx, cy, cz[, vertices[, site_type]])."""
    table = index_atoms(spark.createDataFrame(atoms, ATOMS))
    fields = ["site_id int", "cx double", "cy double", "cz double", "vertices array<int>", "site_type int"]
    rows = [tuple(s) for s in sites] if sites is not None else None
    found = spark.createDataFrame(rows, ", ".join(fields[: len(rows[0])])) if rows else None
    return SiteNetwork(table, Cell.of(cell), found)


def save_network(network: SiteNetwork, path: str) -> None:
    spark = network.atoms.sparkSession
    network.atoms.write.mode("overwrite").parquet(f"{path}/atoms")
    cell = [(i, *map(float, row)) for i, row in enumerate(network.cell.rows)]
    spark.createDataFrame(cell, "row int, x double, y double, z double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cell")
    spark.createDataFrame([(c,) for c in sorted(network.computed)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/computed")
    for name in ("sites", "edges"):
        table = getattr(network, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_network(spark: SparkSession, path: str) -> SiteNetwork:
    cell = Cell.of([(r.x, r.y, r.z) for r in spark.read.parquet(f"{path}/cell").orderBy("row").collect()])
    computed = frozenset(r.name for r in spark.read.parquet(f"{path}/computed").collect())
    tables = {n: spark.read.parquet(f"{path}/{n}") if _exists(spark, f"{path}/{n}") else None for n in ("sites", "edges")}
    return SiteNetwork(spark.read.parquet(f"{path}/atoms"), cell, tables["sites"], tables["edges"], computed)


def save_trajectory(st: SiteTrajectory, path: str, frames_per_part: int = 1_000_000) -> None:
    """Assignments and positions are partitioned by blocks of frames, so that time slices read their files only."""
    save_network(st.network, f"{path}/network")
    for name in ("assign", "frames"):
        table: DataFrame | None = getattr(st, name)
        if table is not None:
            table.withColumn("block", F.floor(F.col("frame") / frames_per_part)).write.mode("overwrite").partitionBy("block").parquet(f"{path}/{name}")


def load_trajectory(spark: SparkSession, path: str) -> SiteTrajectory:
    tables = {n: spark.read.parquet(f"{path}/{n}").drop("block") if _exists(spark, f"{path}/{n}") else None for n in ("assign", "frames")}
    return SiteTrajectory(load_network(spark, f"{path}/network"), tables["assign"], tables["frames"])
