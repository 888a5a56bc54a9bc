"""Text formats of Voronoi tools: node tables, cell headers, and structures to write."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import Cell


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a text file, in order; such files hold one structure."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def parse_nodes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, x, y, z, radius, atoms), (src, dst, radius)) of a file with a vertex and an edge table."""
    marker = F.when(F.lower("text").startswith("vertex table"), "v").when(F.lower("text").startswith("edge table"), "e")
    kept = lines.withColumn("mark", marker).withColumn("part", F.last("mark", ignorenulls=True).over(Window.orderBy("line")))
    rows = kept.where("mark is null and part is not null").withColumn("w", F.split(F.trim("text"), "\\s+")).where(F.size("w") >= 4)
    w = lambda i, t: F.col("w")[i].cast(t)
    nodes = rows.where("part = 'v'").select(w(0, "int").alias("node"), w(1, "double").alias("x"), w(2, "double").alias("y"), w(3, "double").alias("z"), w(4, "double").alias("radius"), F.transform(F.slice("w", F.lit(6), F.greatest(F.size("w") - 5, F.lit(0))), lambda a: a.cast("int")).alias("atoms"))
    edges = rows.where("part = 'e'").select(w(0, "int").alias("src"), w(2, "int").alias("dst"), w(3, "double").alias("radius"))
    return nodes, edges


def parse_cell(lines: DataFrame) -> Cell:
    """The unit cell of a header with va=, vb= and vc= vectors."""
    number = r"([-+0-9.eE]+)"
    found = lines.select(*(F.max(F.regexp_extract("text", rf"v{k}\s*=\s*\(?\s*{number}[\s,]+{number}[\s,]+{number}", i)).alias(f"{k}{i}") for k in "abc" for i in (1, 2, 3))).first()
    if not all(found):
        raise ValueError("no unit cell in the header")
    return Cell.of([[float(found[f"{k}{i}"]) for i in (1, 2, 3)] for k in "abc"])


def cell_parameters(cell: Cell) -> tuple[float, ...]:
    """Lengths and angles in degrees."""
    a = cell.matrix
    n = np.linalg.norm(a, axis=1)
    angle = lambda i, j: float(np.degrees(np.arccos(np.clip(a[i] @ a[j] / n[i] / n[j], -1, 1))))
    return (*map(float, n), angle(1, 2), angle(0, 2), angle(0, 1))


def structure_text(atoms: DataFrame, cell: Cell, title: str = "structure") -> DataFrame:
    """(value) lines: title, cell parameters, then symbol and fractional coordinates of each atom in order."""
    f = cell.fractional(tuple(F.col(c) for c in "xyz"))
    head = atoms.sparkSession.createDataFrame([(-2, title), (-1, "Unit_cell: " + " ".join(f"{p:.6f}" for p in cell_parameters(cell)))], "line long, value string")
    rows = atoms.select(F.col("atom_id").cast("long").alias("line"), F.format_string("%s %.6f %.6f %.6f", F.col("symbol"), *f).alias("value"))
    return head.unionByName(rows).orderBy("line").select("value")
