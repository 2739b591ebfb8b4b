"""Streams in several micro-batches against the batch operators."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from stackweave.operators import telemetry as M
from stackweave.operators.stacks import reconstruct
from stackweave.plans import derive as D
from stackweave.streaming import ingest, reconstruct as live, telemetry

SF = "/root/testdata/sf0.001"


def test_ingest_batches_continue_ids(spark, tmp_path):
    samples = D.raw_samples(spark, SF)
    parts = [samples.filter("seq < 300"), samples.filter("seq between 300 and 699"), samples.filter("seq > 699")]
    for batch, part in enumerate(parts):
        ingest.ingest_batch(part, batch, str(tmp_path))
    # A batch that is run again after a failure changes nothing.
    ingest.ingest_batch(parts[1], 1, str(tmp_path))
    ingest.ingest_batch(parts[2], 2, str(tmp_path))
    rows = ingest.ingested_samples(spark, str(tmp_path)).select(
        (F.col("perfId") / 3).cast("long").alias("seq"), "pid", "tid", "id", "ipLocationId", "addressLocationId")
    wanted = D.branches(spark, SF).select("seq", "pid", "tid", F.col("id").alias("wanted"))
    joined = rows.join(wanted.drop("pid", "tid"), "seq")
    assert rows.count() == 1000 and joined.filter("id <> wanted").count() == 0
    dimension = ingest.ingested_locations(spark, str(tmp_path))
    ids = sorted(r.id for r in dimension.select("id").collect())
    assert ids == list(range(1, len(ids) + 1))
    assert dimension.select("buildId", "dso", "relativeAddress").distinct().count() == len(ids)
    assert rows.join(dimension, rows.ipLocationId == dimension.id, "left_anti").count() == 0


def test_live_stacks_over_batches(spark, tmp_path):
    """Rows in time order, cut in three batches; the fold stays open between them."""
    one = D.branches(spark, SF).withColumn("tid", F.col("tid") * 100 + F.col("pid"))
    locations = D.locations(spark, SF)
    losses = D.aux_loss(spark, SF).withColumn("tid", F.col("tid") * 100 + F.col("pid"))
    day_ms = 86_400_000
    columns = ["tid", "id", "time", "cpu", "flags", "cpumode", "ipLocationId", "addressLocationId"]
    top = one.agg(F.max("time")).first()[0]
    beat = spark.createDataFrame([(-1, 1, top + 100 * day_ms * 10**6, 0, 0, 2, 0, 0)], one.select(*columns).schema)
    cuts = [one.select(*columns).filter("seq < 400"), one.select(*columns).filter("seq between 400 and 700"),
            one.select(*columns).filter("seq > 700"), beat]
    cut_losses = [losses.filter("seq < 400"), losses.filter("seq between 400 and 700"), losses.filter("seq > 700"),
                  losses.limit(0)]
    root = str(tmp_path)
    for part, lost in zip(cuts, cut_losses):
        part.coalesce(2).write.mode("append").parquet(f"{root}/branches")
        lost.select("tid", "time", "cpu").coalesce(1).write.mode("append").parquet(f"{root}/losses")
        stream = live.stream_reconstruct_stacks(
            spark.readStream.schema(part.schema).parquet(f"{root}/branches"), locations,
            spark.readStream.schema("tid long, time long, cpu long").parquet(f"{root}/losses"), "0 seconds", 40 * day_ms)
        query = (stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state")
                 .format("parquet").option("path", f"{root}/out").trigger(availableNow=True).start())
        query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    keep = ["tid", "depth", "startTime", "endTime", "startTrace", "endTrace", "locationId", "startReason", "endReason"]
    batch = reconstruct(one, locations, losses).raw_frames()
    assert sorted(map(tuple, out.select(*keep).collect())) == sorted(map(tuple, batch.select(*keep).collect()))


def _in_batches(spark, parts, build, root):
    """Append each part, then run the stream over what is new; all it wrote."""
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        (stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").format("parquet")
         .option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def test_sliding_window_against_brute_force():
    r = random.Random(2)
    window, rows, time = telemetry.SlidingWindow(50), [], 0
    for i in range(3000):
        time += r.choice([0, 1, 7, 60])
        value = r.choice([None, float(r.randint(-9, 9))])
        rows.append((time, value))
        window.push(time, value)
        window.evict(time)
        seen = [v for t, v in rows if t >= time - 50 and v is not None]
        assert window.read() == (len(seen), sum(seen) / len(seen) if seen else None, max(seen, default=None))
        if i % 100 == 0:  # as state between batches
            window = telemetry.SlidingWindow(50, window.old, window.new)


def test_rate_history_stream(spark, tmp_path):
    """Out of order within a batch, equal times, null rates, in three batches and a last heartbeat."""
    r = random.Random(3)
    rows = [("ab"[r.random() < 0.2], 1_700_000_000_000_000 + (i // 2) * 9_000_000, r.choice([None, float(r.randint(0, 50))])) for i in range(300)]
    parts = [rows[:100], rows[100:220], rows[220:], [("a", rows[-1][1] + 10 ** 9, 1.0)]]
    shape = "stage string, us long, value double"
    frames = []
    for part in parts:
        r.shuffle(part)
        frames.append(spark.createDataFrame(part, shape).select("stage", F.timestamp_micros("us").alias("observed"), "value"))
    out = _in_batches(spark, frames, lambda s: telemetry.stream_rate_history(s, "stage", "value", delay="0 seconds"), str(tmp_path))
    batch = M.rate_history_1m(frames[0].union(frames[1]).union(frames[2]), "stage", "observed", "value")
    keep = ["stage", F.unix_micros("observed").alias("us"), F.coalesce("value", F.lit(-1.0)).alias("value"), "points", F.round("meanRate", 9).alias("mean"), "peakRate"]
    got = sorted(map(repr, out.filter(F.unix_micros("observed") <= rows[-1][1] + 10 ** 8).select(*keep).collect()))
    assert got == sorted(map(repr, batch.select(*keep).collect())) and len(got) == 300


def test_file_status_stream_with_equal_times(spark, tmp_path):
    shape = "file string, status string, buffered long, flushed long, observed timestamp"
    at = [datetime(2024, 1, 1, 0, 0, s) for s in range(10)]
    first = [("f", "OPEN", 5, 20, at[1]), ("f", "OPEN", 3, 10, at[1]), ("f", "OPEN", 0, 0, at[0]), ("g", "OPEN", 1, 1, at[0])]
    second = [("f", "FLUSHING", 0, 80, at[3]), ("f", "OPEN", 9, 20, at[2])]
    third = [("f", "OPEN", 1, 5, at[0]), ("f", "CLOSED", 0, 80, at[5]), ("g", "OPEN", 1, 41, at[4])]
    idle_batches = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(idle_batches, "false")
    try:
        out = _in_batches(spark, [spark.createDataFrame(x, shape) for x in (first, second, third)], telemetry.file_status_stream, str(tmp_path))
        got = sorted((r.file, r.observed, r.flushed, r.status, r.rate) for r in out.collect())
    finally:
        spark.conf.unset(idle_batches)
    assert got == sorted([("f", at[0], 0, "OPEN", 0), ("f", at[1], 10, "OPEN", 10), ("f", at[1], 20, "OPEN", 10), ("f", at[2], 20, "OPEN", 0),
                          ("f", at[3], 80, "FLUSHING", 60), ("f", at[0], 5, "OPEN", 60), ("f", at[5], 80, "CLOSED", 0),
                          ("g", at[0], 1, "OPEN", 0), ("g", at[4], 41, "OPEN", 10)])
