"""The stack fold: rule by rule, split against unsplit, and on random call trees."""

import random

import pytest
from pyspark.sql import functions as F

from stackweave.operators import stack_fold as fold
from stackweave.operators.branches import assign_loss_epoch
from stackweave.operators.stacks import reconstruct

# (id, dso, address, symbol): main, f and g with entry and inner address, and an unnamed place.
LOCATIONS = [(1, "/a", 16, "main"), (2, "/a", 24, "main"), (3, "/a", 64, "f"), (4, "/a", 72, "f"),
             (5, "/a", 128, "g"), (6, "/a", 136, "g"), (7, "", 0, None)]
CALL, RET, BRANCH = 3, 5, 1

# name: rows (id, time, flags, ip, target, cpumode), loss times, frames in emission order
# (location, raw depth, start time, start id, end time, end id, start reason, end reason), counters.
GOLDEN = {
    "call and return": ([(1, 10, CALL, 2, 3, 2), (2, 20, RET, 4, 2, 2)], [],
                        [(3, 1, 10, 1, 20, 2, 0, 2), (2, 0, 10, 1, 20, 2, 0, 5)],
                        dict(calls=1, returns=1, resyncs=1)),
    "nested": ([(1, 10, CALL, 2, 3, 2), (2, 12, CALL, 4, 5, 2), (3, 15, RET, 6, 4, 2), (4, 20, RET, 4, 2, 2),
                (5, 25, BRANCH, 2, 2, 2)], [],
               [(5, 2, 12, 2, 15, 3, 0, 2), (3, 1, 10, 1, 20, 4, 0, 2), (2, 0, 10, 1, 25, 5, 0, 5)],
               dict(calls=2, returns=2, resyncs=1)),
    "loss": ([(1, 10, CALL, 2, 3, 2), (2, 30, RET, 4, 2, 2)], [15],
             [(3, 1, 10, 1, 15, 1, 0, 4), (2, 0, 10, 1, 15, 1, 0, 4)],
             dict(calls=1, returns=1, skippedReturns=1, resyncs=1, lossesApplied=1)),
    "loss at a row's time": ([(1, 10, CALL, 2, 3, 2), (2, 30, RET, 4, 2, 2)], [30],
                             [(3, 1, 10, 1, 30, 2, 0, 2), (2, 0, 10, 1, 30, 2, 0, 4)],
                             dict(calls=1, returns=1, resyncs=1, lossesApplied=1)),
    "mode switch": ([(1, 10, CALL, 2, 3, 2), (2, 20, BRANCH, 7, 7, 1), (3, 30, RET, 4, 2, 2)], [],
                    [(3, 1, 10, 1, 20, 2, 0, 3), (2, 0, 10, 1, 20, 2, 0, 3), (3, 1, 30, 3, 30, 3, 1, 2),
                     (2, 0, 30, 3, 30, 3, 1, 5)],
                    dict(calls=1, returns=2, skippedReturns=1, resyncs=1)),
    "resync": ([(1, 10, CALL, 2, 3, 2), (2, 12, CALL, 4, 5, 2), (3, 20, RET, 4, 2, 2)], [],
               [(3, 1, 10, 1, 20, 3, 0, 2), (2, 0, 10, 1, 20, 3, 0, 5)],
               dict(calls=2, returns=1, resyncs=2, droppedFrames=1)),
    "recursion": ([(1, 10, CALL, 2, 3, 2), (2, 12, CALL, 4, 3, 2), (3, 14, RET, 4, 4, 2), (4, 16, RET, 4, 4, 2),
                   (5, 18, CALL, 4, 4, 2)], [],
                  [(3, 2, 12, 2, 14, 3, 0, 2), (2, 0, 10, 1, 18, 5, 0, 5)],
                  dict(calls=3, ignoredCalls=1, returns=2, ignoredReturns=1, resyncs=1)),
}


def tables(spark, cases):
    rows, losses = [], []
    for tid, (branches, lost, *_) in enumerate(cases, start=1):
        rows += [(i, 1, tid, t, 0, flags, mode, ip, to) for i, t, flags, ip, to, mode in branches]
        losses += [(t, tid, 0) for t in lost]
    return (spark.createDataFrame(rows, "id long, pid long, tid long, time long, cpu long, flags long, cpumode int, "
                                        "ipLocationId long, addressLocationId long"),
            spark.createDataFrame(LOCATIONS, "id long, dso string, relativeAddress long, symbol string")
            .withColumn("relativeAddress", F.col("relativeAddress").cast("decimal(20,0)")),
            spark.createDataFrame(losses, "time long, tid long, cpu long"))


@pytest.mark.parametrize("chunk_rows", [65536, 1, 2])
def test_golden_vectors(spark, chunk_rows):
    cases = list(GOLDEN.values())
    run = reconstruct(*tables(spark, cases), chunk_rows=chunk_rows, fan=2)
    got = {}
    for r in run.raw_frames().orderBy("frameId").collect():
        got.setdefault(r.tid, []).append((r.locationId, r.depth, r.startTime, r.startTrace, r.endTime, r.endTrace,
                                          r.startReason, r.endReason))
    for tid, (name, case) in enumerate(GOLDEN.items(), start=1):
        assert got[tid] == case[2], name
    total = run.summary().first().asDict()
    wanted = {k: sum(c[3].get(k, 0) for c in cases) for k in total}
    wanted["frames"] = sum(len(c[2]) for c in cases)
    assert total == wanted


def test_depths_of_golden_vectors(spark):
    run = reconstruct(*tables(spark, list(GOLDEN.values())))
    depths = {}
    for r in run.frames().orderBy("frameId").collect():
        depths.setdefault(r.tid, []).append(r.depth)
    by_name = dict(zip(GOLDEN, (depths[t] for t in sorted(depths))))
    assert by_name["nested"] == [2, 1, 0]
    # Equal intervals: the callee closes first, has the lower id and so the smaller depth.
    assert by_name["call and return"] == [0, 1]
    assert by_name["mode switch"] == [0, 1, 0, 0]


def test_two_pids_follow_path_order(spark):
    """Pid 10 sorts before pid 9 as text; the open frame carries over and ids restart."""
    branches, locations, losses = tables(spark, [([(1, 10, CALL, 2, 3, 2)], [])])
    both = branches.withColumn("pid", F.lit(10).cast("long")).unionByName(
        branches.withColumns({"pid": F.lit(9).cast("long"), "time": F.lit(5).cast("long"), "flags": F.lit(RET).cast("long"),
                              "ipLocationId": F.lit(4).cast("long"), "addressLocationId": F.lit(2).cast("long")}))
    frames = reconstruct(both, locations, losses).raw_frames().orderBy("frameId").collect()
    assert [(f.locationId, f.startTime, f.endTime) for f in frames] == [(3, 10, 10), (2, 10, 10)]


def test_loss_epochs_use_the_latest_time_so_far(spark):
    rows = [(1, 50, BRANCH, 7, 7, 2), (2, 20, BRANCH, 7, 7, 2), (3, 60, BRANCH, 7, 7, 2)]
    branches, _, losses = tables(spark, [(rows, [10, 30, 50, 55])])
    for chunk_rows in (65536, 1):
        got = {r.id: r.epoch for r in assign_loss_epoch(branches, losses, chunk_rows).collect()}
        assert got == {1: 2, 2: 2, 3: 4}


def random_rows(rng, count, functions):
    rows, time = [], 0
    for trace in range(1, count + 1):
        time += rng.randint(0, 2)
        caller, callee = rng.randint(0, functions), rng.randint(0, functions)
        rows.append((trace, time, trace % 3, int(rng.random() < 0.2), rng.choice([0, 1, 1, 2, 2]), caller, callee,
                     caller == callee and caller > 0, caller * 10, callee * 10, rng.random() < 0.8, caller == 1, callee == 1))
    return rows


def split_fold(rows, losses, size, fan):
    """The chunked fold without Spark."""
    chunks = [rows[at:at + size] for at in range(0, len(rows), size)]
    shares, queue = [], sorted(losses)
    for number, chunk in enumerate(chunks):
        peak = max(r[1] for r in chunk)
        mine = queue if number == len(chunks) - 1 else [x for x in queue if x[0] < peak]
        queue = queue[len(mine):]
        shares.append(mine)
    facts = [fold.summarise_chunk(c, s) for c, s in zip(chunks, shares)]
    runs = [facts[at:at + fan] for at in range(0, len(facts), fan)]
    starts = fold.entry_states([fold.combine_summaries(run) for run in runs])
    states = [s for run, start in zip(runs, starts) for s in fold.entry_states(run, start)]
    counters, frames = fold.Counters(), []
    for number, (chunk, share, state) in enumerate(zip(chunks, shares, states)):
        frames += fold.fold_chunk(chunk, share, fold.unpack_state(state), number == len(chunks) - 1, counters)
    return frames, [getattr(counters, n) for n in counters.__slots__]


@pytest.mark.parametrize("seed", range(150))
def test_split_fold_equals_whole_fold(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(1, 120), rng.randint(1, 7))
    losses = sorted((rng.randint(0, rows[-1][1] + 2), 9) for _ in range(rng.choice([0, 0, 1, 4])))
    counters = fold.Counters()
    whole = fold.fold_chunk(rows, losses, None, True, counters)
    for size, fan in ((1, 1), (2, 3), (5, 2), (13, 4)):
        assert split_fold(rows, losses, size, fan) == (whole, [getattr(counters, n) for n in counters.__slots__])


@pytest.mark.parametrize("seed", range(20))
def test_random_call_trees_come_back(seed):
    """Branches of a balanced call tree give back its intervals."""
    rng, rows, expected = random.Random(seed), [], []

    def step(caller, callee, action, time):
        rows.append((len(rows) + 1, time, 0, 0, action, caller, callee, False, caller, callee, True, caller == 1, callee == 1))

    def visit(function, parent, depth, time):
        started = time
        step(parent, function, fold.CALL, time)
        begun = len(rows)
        for _ in range(rng.randint(0, 3) if depth < 5 else 0):
            time = visit(function + rng.randint(1, 3), function, depth + 1, time + 1)
        time += 1
        step(function, parent, fold.RETURNS, time)
        expected.append((function, depth, started, begun, time, len(rows)))
        return time

    visit(2, 1, 1, 1)
    frames = fold.fold_chunk(rows, [], None, True, fold.Counters())
    got = [(f[6], f[1], f[2], f[4], f[3], f[5]) for f in frames if f[-1] == 2]
    assert got == expected


def test_well_nested_chunks_leave_short_summaries():
    """Calls that return within the chunk leave no step behind."""
    rows = []
    for at in range(1000):
        rows.append((2 * at + 1, at, 0, 0, fold.CALL, 1, 2, False, 1, 2, True, True, False))
        rows.append((2 * at + 2, at, 0, 0, fold.RETURNS, 2, 1, False, 2, 1, True, False, True))
    steps = fold.summarise_chunk(rows, [])["userSteps"]
    assert len(steps) == fold.FRAME_WIDTH + 1
