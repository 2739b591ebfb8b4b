"""Depth normalisation against the plain list rule."""

import random

import pytest

from stackweave.operators import scans
from stackweave.operators.depths import frame_islands, normalize_depths

SCHEMA = ("frameId long, tid long, depth long, startTime long, endTime long, startTrace long, endTrace long, "
          "locationId long, startCpu long, endCpu long, startReason int, endReason int, kind int")


def brute_force(frames):
    """Keep a list of open frames; drop the ended and the not containing; take the smallest free depth."""
    depths, groups = {}, {}
    for f in frames:
        groups.setdefault((f[1], f[12]), []).append(f)
    for group in groups.values():
        open_frames = []
        for f in sorted(group, key=lambda f: (f[3], f[5], -f[4], -f[6], f[0])):
            open_frames = [o for o in open_frames if (o[0][4], o[0][6]) > (f[3], f[5])]
            open_frames = [o for o in open_frames if (o[0][4], o[0][6]) >= (f[4], f[6])]
            used = {depth for _, depth in open_frames}
            depth = next(d for d in range(len(used) + 1) if d not in used)
            open_frames.append((f, depth))
            depths[f[0]] = depth
    return depths


def random_frames(rng, count, tids):
    frames = []
    for frame_id in range(1, count + 1):
        start = rng.randint(0, 60)
        end = start + rng.choice([0, 1, 3, 10, 60])
        trace = rng.randint(1, 4)
        frames.append((frame_id, rng.randint(1, tids), 0, start, end, trace, trace + rng.randint(0, 2) if end == start else
                       rng.randint(1, 6), 1, 0, 0, 0, 2, rng.randint(0, 1)))
    return frames


@pytest.mark.parametrize("tids", [1, 5])
def test_depths_equal_brute_force(spark, tids):
    frames = random_frames(random.Random(tids), 600, tids)
    got = normalize_depths(spark.createDataFrame(frames, SCHEMA).repartition(4))
    assert {r.frameId: r.depth for r in got.collect()} == brute_force(frames)


@pytest.mark.parametrize("chunk_rows, fan", [(16, 3), (300, 1000)])
def test_one_thread_spans_several_chunks(spark, chunk_rows, fan):
    """A single (tid, kind) is cut into chunks of time; the open stack is carried over, run by run."""
    frames = [(1, 7, 0, 0, 10_000 << 16, 0, 0, 1, 0, 0, 0, 2, 0)]
    frames += [(i, 7, 0, i << 16, (i + 3) << 16, i, i + 3, 1, 0, 0, 0, 2, 0) for i in range(2, 2000)]
    table = spark.createDataFrame(frames, SCHEMA)
    assert scans.time_chunks(table, ["tid", "kind"], "startTime", chunk_rows).select("chunk").distinct().count() > 5
    result = normalize_depths(table, chunk_rows, fan).collect()
    assert {r.frameId: r.depth for r in result} == brute_force(frames)


def test_random_frames_over_many_chunks(spark):
    frames = [(f[0], f[1], f[2], f[3] << 16, f[4] << 16, *f[5:]) for f in random_frames(random.Random(5), 500, 2)]
    for chunk_rows, fan in ((2, 2), (40, 4)):
        got = normalize_depths(spark.createDataFrame(frames, SCHEMA).repartition(4), chunk_rows, fan)
        assert {r.frameId: r.depth for r in got.collect()} == brute_force(frames)


def test_islands_over_many_chunks(spark):
    frames = spark.createDataFrame([(f[0], f[1], f[2], f[3] << 18, f[4] << 18, *f[5:]) for f in random_frames(random.Random(6), 300, 3)], SCHEMA)
    one = {r.frameId: r.island for r in frame_islands(frames).collect()}
    assert {r.frameId: r.island for r in frame_islands(frames, 5).collect()} == one and max(one.values()) > 1


def test_plan_writes_nothing(spark):
    """Planning runs no job: chunks come from counted splitters, not from stored range partitions."""
    frames = spark.createDataFrame(random_frames(random.Random(1), 50, 2), SCHEMA)
    spark.sparkContext.setJobGroup("planning", "planning")
    normalize_depths(frames), frame_islands(frames)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    plan = normalize_depths(frames)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_islands(spark):
    rows = [(1, 1, 0, 0, 10, 1, 1, 1, 0, 0, 0, 2, 0), (2, 1, 0, 2, 5, 1, 1, 1, 0, 0, 0, 2, 0),
            (3, 1, 0, 10, 12, 1, 1, 1, 0, 0, 0, 2, 0), (4, 1, 0, 30, 31, 1, 1, 1, 0, 0, 0, 2, 0)]
    got = {r.frameId: r.island for r in frame_islands(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3}
