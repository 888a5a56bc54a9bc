"""The driver's tables as inputs of the analyses, and the same in SQL for the oracles.

Events become assignments: the daily fixture is rectangular (a frame a day of
the month, the last event of a day), the event fixture has a frame an event.
Suppliers become static points, nations centers, in a triclinic cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import Cell

CELL = Cell.of([[10, 0, 0], [2, 9, 0], [1, 1.5, 8]])
N_SITES = 5
_SITES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _site(column: str, names) -> F.Column:
    out = F.lit(-1)
    for i, n in reversed(list(enumerate(names))):
        out = F.when(F.col(column) == n, i).otherwise(out)
    return out.cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, mobile, site, confidence), one row an event; errors are unknown."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return rows.select((F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("user_id").alias("mobile"), _site("event_type", ("click", "purchase", "signup", "view")).alias("site"), (F.col("value") / 500.0).alias("confidence"))


EVENTS = """ev as (select user_id as mobile, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
  case event_type when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 else -1 end as site, value / 5e2 as confidence from events)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, mobile, site) of every particle on every day."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mobile"), (F.dayofmonth("ts") - 1).cast("long").alias("frame"), _site("event_type", _SITES).alias("site"), "ts")
    last = rows.groupBy("mobile", "frame").agg(F.max_by("site", "ts").alias("site"))  # numbers, so that it is hashed and not sorted
    days = rows.agg(F.collect_set("frame").alias("days"))  # at most 31
    spine = last.select("mobile").distinct().join(F.broadcast(days)).select("mobile", F.explode("days").alias("frame"))
    return spine.join(last, ["mobile", "frame"], "left").select("frame", "mobile", F.coalesce("site", F.lit(-1)).alias("site"))


DAILY = """dm as (select distinct user_id as mobile from events), df as (select distinct dayofmonth(ts) - 1 as frame from events),
dl as (select user_id as mobile, dayofmonth(ts) - 1 as frame, max_by(event_type, ts) as et from events group by all),
d as (select cast(df.frame as bigint) as frame, dm.mobile, case dl.et when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 else -1 end as site
      from dm cross join df left join dl on dl.mobile = dm.mobile and dl.frame = df.frame)"""


def graph_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily assignments with sites split by particle, for a graph of 25 sites in five parts."""
    return daily(spark, sf_dir).withColumn("site", F.when(F.col("site") >= 0, F.col("site") + 5 * (F.col("mobile") % 5)).otherwise(-1).cast("int"))


GRAPH = DAILY + ",\ng as (select frame, mobile, case when site >= 0 then cast(site + 5 * (mobile % 5) as integer) else -1 end as site from d)"


def sites(spark: SparkSession, n: int = N_SITES, types: bool = True) -> DataFrame:
    """n sites; even ones of type 0, odd ones of type 1."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("site_id"))
    return rows.withColumn("site_type", (F.col("site_id") % 2).cast("int")) if types else rows


SITES = "st as (select cast(range as integer) as site_id, cast(range % 2 as integer) as site_type from range(5))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z) of suppliers."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (F.col("s_acctbal") / 150.0).alias("x"), (F.col("s_nationkey") * 1.7).alias("y"), ((k % 17) * 1.3).alias("z"))


POINTS = "pt as (select s_suppkey as id, s_acctbal / 150e0 as x, s_nationkey * 17e-1 as y, (s_suppkey % 17) * 13e-1 as z from supplier)"


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z) of nations."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("id"), (k * 0.41).alias("x"), ((k % 7) * 1.37).alias("y"), ((k % 5) * 1.71).alias("z"))


CENTERS = "ct as (select n_nationkey as id, n_nationkey * 41e-2 as x, (n_nationkey % 7) * 137e-2 as y, (n_nationkey % 5) * 171e-2 as z from nation)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily assignments with positions: (frame, mobile, site, x, y, z)."""
    m, f = F.col("mobile"), F.col("frame")
    return daily(spark, sf_dir).select("frame", "mobile", "site", ((m % 10) + f * 0.1).alias("x"), ((m % 9) * 1.1 + F.col("site") * 0.2).alias("y"), ((m % 8) * 0.9).alias("z"))


POSITIONS = DAILY + ",\npo as (select frame, mobile, site, (mobile % 10) + frame * 1e-1 as x, (mobile % 9) * 11e-1 + site * 2e-1 as y, (mobile % 8) * 9e-1 as z from d)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v array<double>)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


# Geometry in SQL, for the oracles: three expressions a point.


def _apply(p, m) -> tuple[str, str, str]:
    return tuple(f"({p[0]} * ({float(m[0, j])!r}) + {p[1]} * ({float(m[1, j])!r}) + {p[2]} * ({float(m[2, j])!r}))".replace("e-", "e-") for j in range(3))


def _float(sql: str) -> str:
    """Plain decimals are exact numerics in SQL; exponents make them doubles."""
    import re

    return re.sub(r"\((-?\d+\.\d+)\)", r"(\1e0)", sql)


def sql_fractional(p) -> tuple[str, ...]:
    return tuple(map(_float, _apply(p, CELL.inverse)))


def sql_cartesian(f) -> tuple[str, ...]:
    return tuple(map(_float, _apply(f, CELL.matrix)))


def sql_wrap(p) -> tuple[str, ...]:
    return sql_cartesian(tuple(f"({f} - floor({f}))" for f in sql_fractional(p)))


def sql_recentred(p, on) -> tuple[str, ...]:
    return sql_wrap(tuple(f"({a} - {b} + {float(c)!r}e0)" for a, b, c in zip(p, on, CELL.centroid)))


def sql_distance(p, q) -> str:
    r = sql_recentred(q, p)
    return "sqrt(" + " + ".join(f"pow({a} - {float(c)!r}e0, 2)" for a, c in zip(r, CELL.centroid)) + ")"


def sql_images(p) -> list[tuple[int, tuple[str, str, str]]]:
    out = []
    for i in range(27):
        s = [i // 9 - 1, i // 3 % 3 - 1, i % 3 - 1] @ CELL.matrix
        out.append((100 * (i // 9) + 10 * (i // 3 % 3) + i % 3, tuple(f"({a} + ({float(x)!r}e0))" for a, x in zip(p, s))))
    return out
