"""The elbow of a decreasing curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elbow_index(points: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, elbow): the index, in descending order of *value*, of the point farthest from the first-last chord.

    The first of equally far points wins. A curve is small (cluster decision
    values): each group's curve is ordered in one task.
    """
    keys = keys or []
    order = Window.partitionBy(*keys).orderBy(F.desc(value))
    whole = Window.partitionBy(*keys)
    ranked = points.select(*keys, F.col(value).cast("double").alias("v"), (F.row_number().over(order) - 1).alias("i"))
    ends = ranked.withColumns({"n": F.max("i").over(whole), "hi": F.max("v").over(whole), "lo": F.min("v").over(whole)})
    far = F.abs(F.col("n") * (F.col("v") - F.col("hi")) - F.col("i") * (F.col("lo") - F.col("hi")))  # times the chord's length
    return ends.groupBy(*keys).agg(F.max(F.struct(F.round(far, 9).alias("d"), (-F.col("i")).alias("i")))["i"].alias("i")).select(*keys, (-F.col("i")).cast("int").alias("elbow"))
