"""Losses against rows: the merge by common splitters against the queue rule."""

import random

from pyspark.sql import functions as F

from stackweave.operators import branches as B


def make(spark, rng, rows, losses):
    branches, time = [], {}
    for tid, pid, number in sorted((rng.randint(1, 2), rng.randint(1, 2), i) for i in range(rows)):
        time[tid] = time.get(tid, 0) + rng.choice([0, 1, 1, 5, -2])
        branches.append((tid, pid, time[tid] << 17))
    ids, out = {}, []
    for tid, pid, at in branches:
        ids[tid, pid] = ids.get((tid, pid), 0) + 1
        out.append((pid, tid, ids[tid, pid], at))
    lost = [(rng.randint(1, 3), rng.randint(-3, 2 * rows) << 17, rng.randint(0, 3)) for _ in range(losses)]
    return (out, spark.createDataFrame(out, "pid long, tid long, id long, time long").repartition(3), lost,
            spark.createDataFrame(lost, "tid long, time long, cpu long").repartition(3))


def test_epochs_against_the_queue(spark):
    for seed, chunk_rows in ((1, 1000), (2, 8), (3, 30)):
        rows, branches, lost, losses = make(spark, random.Random(seed), 150, 90)
        wanted, reached = {}, {}
        for pid, tid, number, time in sorted(rows, key=lambda r: (r[1], str(r[0]), r[2])):
            reached[tid] = max(reached.get(tid, time), time)
            wanted[pid, tid, number] = sum(t == tid and at < reached[tid] for t, at, _ in lost)
        got = {(r.pid, r.tid, r.id): r.epoch for r in B.assign_loss_epoch(branches, losses, chunk_rows).collect()}
        assert got == wanted


def test_chunks_of_losses(spark):
    for seed, chunk_rows, most in ((4, 10, 1 << 16), (5, 10, 6)):
        rows, branches, lost, losses = make(spark, random.Random(seed), 150, 90)
        positioned = B.thread_positions(branches, chunk_rows)
        order, last = {}, {}
        for r in positioned.collect():
            order.setdefault(r.tid, []).append((r.position, r.time, r.chunk))
            last[r.tid] = r.lastChunk
        wanted, trailing = [], {}
        for tid, at, _ in lost:
            later = [c for _, t, c in sorted(order.get(tid, [])) if t > at]
            if later:
                wanted.append((tid, later[0], at))
            elif tid in order:
                trailing[tid] = min(trailing.get(tid, at), at)
        wanted += [(tid, last[tid], at) for tid, at in trailing.items()]
        got = sorted((r.tid, r.chunk, r.lossTime) for r in B.losses_by_chunk(positioned, losses, most).collect())
        assert got == sorted(wanted)


def test_many_losses_of_one_thread_spread(spark):
    """200,000 losses of one thread, half of them after its last row, are merged in many groups."""
    losses = spark.range(200_000).select(F.lit(7).cast("long").alias("tid"), (F.col("id") * 100_000).alias("time"), F.lit(0).cast("long").alias("cpu"))
    branches = spark.range(1000).select(F.lit(1).cast("long").alias("pid"), F.lit(7).cast("long").alias("tid"), (F.col("id") + 1).alias("id"),
                                        (F.col("id") * 10_000_000 + 1).alias("time"))
    cut = B.scans.time_chunks(losses, ["tid"], "time", 10_000)
    sizes = [r["count"] for r in cut.groupBy("chunk").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 10_000
    got = B.assign_loss_epoch(branches, losses, 10_000).agg(F.max("epoch").alias("high"), F.count_if(F.expr("epoch = (id - 1) * 100 + 1")).alias("right")).first()
    assert got.high == 99_901 and got.right == 1000
    placed = B.losses_by_chunk(B.thread_positions(branches, 100), losses, 10_000)
    assert placed.count() == 99_902 and placed.filter("lossTime > 9990000001").count() == 1
