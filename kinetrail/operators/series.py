"""Ordered-series operators on assignments (frame, mobile, site[, confidence]).

All windows share one specification, particles partitioned and frames
ordered, so that Spark sorts once however many operators are stacked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNKNOWN = -1


def by_particle() -> WindowSpec:
    return Window.partitionBy("mobile").orderBy("frame")


def before() -> WindowSpec:
    return by_particle().rowsBetween(Window.unboundedPreceding, -1)


def after() -> WindowSpec:
    return by_particle().rowsBetween(1, Window.unboundedFollowing)


def known(site: Column | str = "site") -> Column:
    """The site, null if unknown."""
    return F.nullif(F.col(site) if isinstance(site, str) else site, F.lit(UNKNOWN))


def last_known(default: Column | None = None) -> Column:
    """The last known site strictly before a row."""
    return F.coalesce(F.last(known(), ignorenulls=True).over(before()), default if default is not None else F.lit(UNKNOWN))


def next_known() -> Column:
    return F.coalesce(F.first(known(), ignorenulls=True).over(after()), F.lit(UNKNOWN))


def jumps(assign: DataFrame, unknown_as_jump: bool = False) -> DataFrame:
    """(frame, mobile, from_site, to_site) of each jump, from frame 1 on.

    By default unknowns are looked through (the first site after leading
    unknowns is a jump from -1); else any change between frames is a jump.
    """
    previous = F.lag("site").over(by_particle()) if unknown_as_jump else last_known()
    moved = assign.select("frame", "mobile", F.col("site").alias("to_site"), previous.alias("from_site")).where("frame > 0 and from_site <> to_site")
    if not unknown_as_jump:
        moved = moved.where(F.col("to_site") != UNKNOWN)
    return moved.select("frame", "mobile", "from_site", "to_site")


def jumps_by_frame(assign: DataFrame, unknown_as_jump: bool = False) -> DataFrame:
    """(frame, jumps): each frame from 1 on with its jumps, ordered by particle; an empty array without any."""
    found = jumps(assign, unknown_as_jump).groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("mobile", "from_site", "to_site"))).alias("jumps"))
    spine = assign.where("frame > 0").select("frame").distinct()
    empty = F.array().cast("array<struct<mobile:bigint,from_site:int,to_site:int>>")
    return spine.join(found.withColumn("jumps", F.col("jumps").cast("array<struct<mobile:bigint,from_site:int,to_site:int>>")), "frame", "left").select("frame", F.coalesce("jumps", empty).alias("jumps"))


def effective(assign: DataFrame) -> DataFrame:
    """Adds last_known, effective (the site, or the last known), both_known, jumped and lag.

    In frame 0 a particle's own site counts as its last known.  The lag of a
    jump is the time since the previous one, counted from frame -1.
    """
    seen = assign.withColumn("last_known", F.when(F.col("frame") == 0, F.col("site")).otherwise(last_known()))
    both = seen.withColumn("effective", F.coalesce(known(), F.col("last_known"))).withColumn("both_known", (F.col("effective") >= 0) & (F.col("last_known") >= 0))
    moved = both.withColumn("jumped", F.col("both_known") & (F.col("effective") != F.col("last_known")))
    return moved.withColumn("lag", (F.col("frame") - F.coalesce(F.max(F.when(F.col("jumped"), F.col("frame"))).over(before()), F.lit(-1))).cast("long"))


def _unknown_time() -> Column:
    """How many frames a particle has been unknown before this one, within the current run."""
    return F.col("frame") - F.coalesce(F.last(F.when(F.col("site") != UNKNOWN, F.col("frame")), ignorenulls=True).over(before()), F.lit(-1)) - 1


def assign_to_last_known(assign: DataFrame, frame_threshold: int = 1) -> DataFrame:
    """Fill the first *frame_threshold* frames of each unknown run with the last known site."""
    marked = assign.withColumns({"__time": _unknown_time(), "__last": last_known()})
    fill = (F.col("site") == UNKNOWN) & (F.col("__time") < frame_threshold)
    return marked.withColumn("site", F.when(fill, F.col("__last")).otherwise(F.col("site")).cast("int")).drop("__time", "__last")


def fill_statistics(assign: DataFrame, frame_threshold: int = 1, legacy: bool = False) -> DataFrame:
    """One row: max_time_unknown, avg_time_unknown, total_reassigned of the fill.

    Runs still open at the end are not averaged; leading unknown frames within
    the threshold count as reassigned.  The maximum is over closed runs longer
    than the threshold; with *legacy* it is the last frame's maximum of these.
    Without closed runs all three are 0.
    """
    marked = assign.withColumn("time", _unknown_time())
    closed = (F.col("site") != UNKNOWN) & (F.col("time") > 0)
    if legacy:
        longest = marked.where(closed & (F.col("time") > frame_threshold)).agg(F.max(F.struct("frame", "time"))["time"].alias("longest"))
    else:
        longest = marked.agg(F.max(F.when(closed & (F.col("time") > frame_threshold), F.col("time"))).alias("longest"))
    rest = marked.agg(F.avg(F.when(closed, F.col("time"))).alias("mean"), F.count_if((F.col("site") == UNKNOWN) & (F.col("time") < frame_threshold)).alias("filled"))
    some = F.col("mean").isNotNull()
    return longest.crossJoin(rest).select(  # one row each
        F.when(some, F.coalesce("longest", F.lit(0))).otherwise(0).cast("long").alias("max_time_unknown"),
        F.coalesce("mean", F.lit(0.0)).alias("avg_time_unknown"),
        F.when(some, F.col("filled")).otherwise(0).cast("long").alias("total_reassigned"),
    )


def replace_unassigned(assign: DataFrame, how: str | Callable[[Column, Column], Column] = "last") -> DataFrame:
    """Replace unknown runs: by the known site before (``last``), behind (``next``), or an expression of the two."""
    both = assign.withColumns({"__before": last_known(), "__after": next_known()})
    pick = {"last": lambda b, a: b, "next": lambda b, a: a}.get(how, how)
    filled = F.when(F.col("site") == UNKNOWN, pick(F.col("__before"), F.col("__after"))).otherwise(F.col("site"))
    return both.withColumn("site", filled.cast("int")).drop("__before", "__after")


def replace_with_closer(assign: DataFrame, frames: DataFrame, sites: DataFrame, cell) -> DataFrame:
    """Replace an unknown by whichever of its neighbours in time is nearer in space; ties go to the later one.

    *frames* has frame, mobile, x, y, z; a neighbour that is itself unknown
    leaves the other.
    """
    from ..functions.geometry import point

    both = assign.withColumns({"__before": last_known(), "__after": next_known()}).join(frames.select("frame", "mobile", "x", "y", "z"), ["frame", "mobile"], "left")
    centers = lambda tag: F.broadcast(sites.select(F.col("site_id").alias(f"__{tag}"), *(F.col(f"c{c}").alias(f"{tag}{c}") for c in "xyz")))
    near = both.join(centers("before"), "__before", "left").join(centers("after"), "__after", "left")
    here = point("x", "y", "z")
    db, da = (cell.distance(here, point(*(f"{t}{c}" for c in "xyz"))) for t in ("before", "after"))
    pick = F.when(F.col("__after") == UNKNOWN, F.col("__before")).when(F.col("__before") == UNKNOWN, F.col("__after")).when(db < da, F.col("__before")).otherwise(F.col("__after"))
    return near.withColumn("site", F.when(F.col("site") == UNKNOWN, pick).otherwise(F.col("site")).cast("int")).select(*assign.columns)


def replace_runs(assign: DataFrame, function: Callable) -> DataFrame:
    """Replace unknown runs by ``function(mobile, before, start, after, end)``: a site, or one for each frame of start..end-1.

    The general form, a particle at a time in Arrow batches; one particle's
    series has to fit a task.
    """

    def run(pdf):
        pdf = pdf.sort_values("frame", ignore_index=True)
        site = pdf["site"].to_numpy().copy()
        i = 0
        while i < len(site):
            if site[i] == UNKNOWN:
                j = i
                while j < len(site) and site[j] == UNKNOWN:
                    j += 1
                site[i:j] = function(pdf["mobile"].iloc[0], site[i - 1] if i else UNKNOWN, i, site[j] if j < len(site) else UNKNOWN, j)
                i = j
            else:
                i += 1
        return pdf.assign(site=site.astype("int32"))

    return assign.withColumn("site", F.col("site").cast("int")).groupBy("mobile").applyInPandas(run, assign.withColumn("site", F.col("site").cast("int")).schema)


def rolling_mode(assign: DataFrame, threshold: int, window_factor: float = 2.1, set_unassigned: bool = True) -> DataFrame:
    """The most frequent site in a window about each frame.

    The window is floor(w/2) frames back to ceil(w/2) - 1 ahead, w =
    window_factor * threshold, cut off at the ends; unknown counts as a value;
    of equally frequent values the lowest wins.  Where the winner has fewer
    than *threshold* frames the result is unknown, or the original site.
    """
    import math

    w = window_factor * threshold
    around = by_particle().rowsBetween(-math.floor(w / 2), math.ceil(w / 2) - 1)
    # The window's sites in order, runs of equal ones counted in one pass; of equally long runs the first, that is the lowest, stays.
    start = F.struct(F.lit(None).cast("int").alias("site"), F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(UNKNOWN).alias("best"))

    def count(held: Column, site: Column) -> Column:
        run = F.when(held["site"] == site, held["run"] + 1).otherwise(1)
        longer = run > held["n"]
        return F.struct(site.cast("int").alias("site"), run.alias("run"), F.when(longer, run).otherwise(held["n"]).alias("n"), F.when(longer, site.cast("int")).otherwise(held["best"]).alias("best"))

    rest = F.lit(UNKNOWN) if set_unassigned else F.col("site")
    scored = assign.withColumn("__held", F.collect_list("site").over(around)).withColumn("__won", F.aggregate(F.array_sort("__held"), start, count))
    smooth = F.when(F.col("__won")["n"] >= threshold, F.col("__won")["best"]).otherwise(rest)
    return scored.withColumn("site", smooth.cast("int")).drop("__held", "__won", "confidence")


def site_ranks(rows: DataFrame, name: str, site: str = "site") -> DataFrame:
    """Adds *name*, each row's place from 0 among its site's in the order of frame and particle.

    Places are a prefix sum of the site's counts by frame plus the place within
    the frame, so that a site's rows are never sorted in one task.
    """
    per = rows.groupBy(site, "frame").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(site).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.select(site, "frame", ahead.alias("__base"))
    local = F.row_number().over(Window.partitionBy(site, "frame").orderBy("mobile")) - 1
    return rows.withColumn("__local", local).join(base, [site, "frame"]).withColumn(name, F.col("__base") + F.col("__local")).drop("__base", "__local")


def runs(assign: DataFrame) -> DataFrame:
    """Run-length encoding: (mobile, start, length, site) of each run of equal sites."""
    change = F.coalesce((F.col("site") != F.lag("site").over(by_particle())).cast("int"), F.lit(0))
    marked = assign.select("mobile", "frame", "site", change.alias("change")).withColumn("run", F.sum("change").over(by_particle()))
    return marked.groupBy("mobile", "run").agg(F.min("frame").alias("start"), F.count("*").alias("length"), F.first("site").alias("site")).drop("run")


def timeline(assign: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Segments for plotting a particle: runs with their known flag, and the site's type where sites have one."""
    found = runs(assign).withColumn("known", F.col("site") != UNKNOWN)
    if sites is not None and "site_type" in sites.columns:
        found = found.join(F.broadcast(sites.select(F.col("site_id").alias("site"), "site_type")), "site", "left")
    return found


def displacements(frames: DataFrame) -> DataFrame:
    """(frame, atom_id, dx, dy, dz) from each frame to the next, without periodicity."""
    w = Window.partitionBy("atom_id").orderBy("frame")
    return frames.select("frame", "atom_id", *((F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in "xyz")).where("dx is not null")


def every(df: DataFrame, step: int) -> DataFrame:
    """Every step-th frame."""
    return df.where(F.col("frame") % step == 0)
