"""Series operators against sequential models and the hand-made fixtures."""

import random

import pytest

from kinetrail.operators import jump_statistics as js
from kinetrail.operators import series


def assign(spark, *particles):
    rows = [(f, m, s) for m, p in enumerate(particles) for f, s in enumerate(p)]
    return spark.createDataFrame(rows, "frame long, mobile long, site int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def by_particle(df):
    out = {}
    for r in df.orderBy("mobile", "frame").collect():
        out.setdefault(r.mobile, []).append(r.site)
    return list(out.values())


def test_a_jump_between_two_frames(spark):
    assert rows(series.jumps(assign(spark, [0, 0], [4, 5]))) == [(1, 1, 4, 5)]


def test_unknown_sites_in_jumps(spark):
    a = assign(spark, [-1, 0, -1, 1])
    assert rows(series.jumps(a)) == [(1, 0, -1, 0), (3, 0, 0, 1)]
    assert rows(series.jumps(a, True)) == [(1, 0, -1, 0), (2, 0, 0, -1), (3, 0, -1, 1)]


def test_jumps_by_frame_lists_every_frame(spark):
    found = {r.frame: len(r.jumps) for r in series.jumps_by_frame(assign(spark, [0, 0, 1], [2, 2, 3])).collect()}
    assert found == {1: 0, 2: 2}


def test_the_first_residence_counts_a_frame_more(spark):
    eff = series.effective(assign(spark, [0, 0, 1, 0]))
    assert {(r.src, r.dst): r.jump_lag for r in js.jump_lags(eff).collect()} == {(0, 1): 3.0, (1, 0): 1.0}


def test_particles_on_one_transition_count_once(spark):
    eff = series.effective(assign(spark, [0, 1], [0, 1]))
    assert rows(js.transition_counts(eff)) == [(0, 0, 1.0), (0, 1, 1.0)]
    assert rows(js.corrected_residences(eff)) == [(0, 1), (1, 1)]
    assert rows(js.transition_counts(eff, count_rows=True)) == [(0, 0, 2.0), (0, 1, 2.0)]


def test_gap_filling(spark):
    a = assign(spark, [2, -1, -1, -1, 3])
    assert by_particle(series.assign_to_last_known(a, 2)) == [[2, 2, 2, -1, 3]]
    assert tuple(series.fill_statistics(a, 2).first()) == (3, 3.0, 2)
    assert series.fill_statistics(a, 3).first().max_time_unknown == 0
    assert by_particle(series.replace_unassigned(a, "next")) == [[2, 3, 3, 3, 3]]
    assert by_particle(series.replace_runs(a, lambda m, before, i, after, j: range(10, 10 + j - i))) == [[2, 10, 11, 12, 3]]


def test_gap_filling_without_any_gap(spark):
    assert tuple(series.fill_statistics(assign(spark, [0, 1]), 1).first()) == (0, 0.0, 0)


def test_rolling_mode_window(spark):
    assert by_particle(series.rolling_mode(assign(spark, [0, 0, 1, 0, 0]), 2)) == [[0] * 5]


def sequential(particles):
    """The statistics by a loop over frames: last known sites, times, counts with one count a frame."""
    n = len(particles)
    last, time = [p[0] for p in particles], [1] * n
    nij, total, lag, lags = {}, {}, {}, {}
    for f in range(len(particles[0])):
        now = [p[f] if p[f] >= 0 else last[i] for i, p in enumerate(particles)]
        ok = [now[i] >= 0 and last[i] >= 0 for i in range(n)]
        for key in {(last[i], now[i]) for i in range(n) if ok[i]}:
            nij[key] = nij.get(key, 0) + 1
        for s in {now[i] for i in range(n) if ok[i]}:
            total[s] = total.get(s, 0) + 1
        seen = {}
        for i in range(n):
            if ok[i] and now[i] != last[i]:
                seen[(last[i], now[i])] = time[i]
        for key, t in seen.items():
            lags.setdefault(key, []).append(t)
        for i in range(n):
            time[i] = 1 if ok[i] and now[i] != last[i] else time[i] + 1
            if particles[i][f] >= 0:
                last[i] = particles[i][f]
    return nij, total, {k: sum(v) / len(v) for k, v in lags.items()}


@pytest.mark.parametrize("seed", range(3))
def test_statistics_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    particles = [[draw.choice([-1, -1, 0, 1, 2]) for _ in range(25)] for _ in range(6)]
    nij, total, lag = sequential(particles)
    eff = series.effective(assign(spark, *particles))
    assert {(r.src, r.dst): r.n_ij for r in js.transition_counts(eff).collect()} == nij
    assert {r.site_id: r.total_corrected_residences for r in js.corrected_residences(eff).collect()} == total
    assert {(r.src, r.dst): r.jump_lag for r in js.jump_lags(eff).collect()} == pytest.approx(lag)
    both = js.transitions(eff).collect()
    assert {(r.src, r.dst): r.n_ij for r in both} == nij and {(r.src, r.dst): r.jump_lag for r in both if r.jump_lag is not None} == pytest.approx(lag)


def test_entropy_of_two_equal_sites(spark):
    residences = spark.createDataFrame([(0, 5), (1, 5)], "site_id int, total_corrected_residences long")
    sites = spark.createDataFrame([(0,), (1,)], "site_id int")
    assert js.configurational_entropy(residences, sites, 10).first().entropy == pytest.approx(1.3862943611)


def test_streaming_equals_batch(spark, tmp_path):
    from kinetrail.streaming.jumps import stream_jumps

    draw = random.Random(4)
    a = assign(spark, *[[draw.choice([-1, 0, 1]) for _ in range(20)] for _ in range(3)])
    for k in range(2):
        a.where(f"frame between {10 * k} and {10 * k + 9}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = stream_jumps(stream, 1).writeStream.format("memory").queryName("jumps_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    out = spark.table("jumps_out").cache()
    if not out.where("late").count():  # the files may come in either order
        assert rows(out.where("jumped").select("frame", "mobile", "from_site", "site")) == rows(series.jumps(a))
        assert by_particle(out) == by_particle(series.assign_to_last_known(a, 1))
