"""Call stacks from branches: fold, frame ids, depths and the run summary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stackweave.operators import scans, stack_fold as fold
from stackweave.operators.branches import (classify_branches, losses_by_chunk, thread_positions,
                                           trace_clips)
from stackweave.operators.depths import normalize_depths
from stackweave.session import durable

ROW_FIELDS = ["trace", "time", "cpu", "kind", "action", "caller", "callee", "same",
               "callerLocation", "calleeLocation", "callerNamed", "callerMain", "calleeMain"]
FRAME_FIELDS = ["kind", "depth", "startTime", "endTime", "startTrace", "endTrace", "locationId",
                 "startCpu", "endCpu", "startReason", "endReason"]
_COUNT_FIELDS = ["frames", "skippedReturns", "ignoredReturns", "resyncs", "droppedFrames"]
_SUMMARY_SCHEMA = (
    "tid long, chunk long, lastChunk long, active long, lastTrace long, lastTime long, lastCpu long, first array<long>, "
    + ", ".join(f"{k}Steps array<long>, {k}Cleared long, {k}Restart array<long>" for k in ("user", "kernel")))
_RAW_SCHEMA = "tid long, chunk long, n long, " + ", ".join(
    f"{c} long" for c in FRAME_FIELDS + _COUNT_FIELDS)

_ROW, _LOSS, _STATE = 0, 1, 2
# Chunks per combined run.
CHUNK_FAN = 256


def fold_columns() -> list[Column]:
    """Integer columns for the fold from classified rows, named as the helper names them."""
    action = (F.when(F.col("isCall") & F.col("isStackCall"), fold.CALL)
              .when(F.col("isReturn"), fold.RETURNS).otherwise(fold.NOTHING))

    def of_target(target: str, ip: str) -> Column:
        return F.when(F.col("addressLocationId") != 0, F.col(target)).otherwise(F.col(ip))

    values = {
        "trace": F.col("id"), "time": F.col("time"), "cpu": F.col("cpu"), "kind": F.col("kind"),
        "action": action, "caller": F.col("ipFunction"),
        "callee": of_target("addressFunction", "ipFunction"), "same": F.col("sameFunction"),
        "callerLocation": F.col("ipLocationId"),
        "calleeLocation": of_target("addressLocationId", "ipLocationId"),
        "callerNamed": F.col("ipHasSymbol"), "callerMain": F.col("ipIsMain"),
        "calleeMain": of_target("addressIsMain", "ipIsMain"),
    }
    return [values[name].cast("long").alias(name) for name in ROW_FIELDS]


def _no_state() -> Column:
    return F.lit(None).cast("array<long>").alias("state")


def _fill(name: str) -> Column:
    source = {"ord": "lossTime", "time": "lossTime", "cpu": "lossCpu"}.get(name)
    return (F.col(source) if source else F.lit(0).cast("long")).alias(name)


def _known(values: list) -> list:
    """Missing values of a chunk's column as NaN, next to which all of its numbers are floats."""
    return [float("nan") if v is None else float(v) for v in values] if None in values else values


def _groups(table: pa.Table, borders: list[int]) -> Iterator[tuple[list, list, list | None]]:
    """Rows, losses and entry state of each chunk; rows come by tag and order."""
    tags, states = table.column("tag").to_numpy(), table.column("state")
    columns = scans.lists(table, ROW_FIELDS)
    time, cpu = columns[ROW_FIELDS.index("time")], columns[ROW_FIELDS.index("cpu")]
    missing = any(table.column(name).null_count for name in ROW_FIELDS)
    rows, losses = list(zip(*columns)), list(zip(time, cpu))
    for a, b in zip(borders, borders[1:]):
        own = tags[a:b]
        lost, stated = a + int((own == _ROW).sum()), b - int((own == _STATE).sum())
        state = states[stated].as_py() if stated < b else None
        if missing:
            yield list(zip(*[_known(c[a:lost]) for c in columns])), list(zip(_known(time[lost:stated]), _known(cpu[lost:stated]))), state
        else:
            yield rows[a:lost], losses[lost:stated], state


def _summarise(table: pa.Table, borders: list[int]) -> pa.Table:
    heads = scans.lists(table.take(pa.array(borders[:-1], pa.int64())), ["tid", "chunk", "lastChunk"])
    facts = [fold.summarise_chunk(rows, losses) for rows, losses, _ in _groups(table, borders)]
    for fact, tid, chunk, last in zip(facts, *heads):
        fact.update(tid=tid, chunk=chunk, lastChunk=last)
    return _fact_table(facts)


def _fact_table(facts: list[dict]) -> pa.Table:
    columns = [part.split() for part in _SUMMARY_SCHEMA.split(", ")]
    return pa.table({name: pa.array([f[name] for f in facts], pa.list_(pa.int64()) if "array" in kind else pa.int64())
                     for name, kind in columns})


def _combine(table: pa.Table, borders: list[int]) -> pa.Table:
    chunks, facts = table.to_pylist(), []
    for a, b in zip(borders, borders[1:]):
        facts.append(fold.combine_summaries(chunks[a:b]))
        facts[-1].update(tid=chunks[a]["tid"], chunk=chunks[a]["run"], lastChunk=0)
    return _fact_table(facts)


def _entries(table: pa.Table, borders: list[int]) -> pa.Table:
    """Entry states of consecutive chunks; a row that brings a state, before its chunks, is what they begin with."""
    chunks, found = table.to_pylist(), []
    for a, b in zip(borders, borders[1:]):
        initial, first = chunks[a].get("state"), a
        if initial is not None:
            first += 1
        found += zip(chunks[first:b], fold.entry_states(chunks[first:b], initial))
    numbers = {name: pa.array([f[name] for f, _ in found], pa.int64()) for name in ("tid", "chunk", "lastChunk")}
    return pa.table({**numbers, "state": pa.array([state for _, state in found], pa.list_(pa.int64()))})


def _chunk_states(summaries: DataFrame, fan: int) -> DataFrame:
    """Entry state of every chunk of the long threads.

    Runs of `fan` chunks are combined side by side, one row per run is scanned over the thread,
    and the runs then find their chunks' states side by side.
    """
    schema = "tid long, chunk long, lastChunk long, state array<long>"
    summaries = durable(summaries.withColumn("run", scans.whole(F.col("chunk"), fan)))
    runs = scans.map_groups(summaries, ["tid", "run"], ["chunk"], _combine, _SUMMARY_SCHEMA)
    starts = scans.map_groups(runs, ["tid"], ["chunk"], _entries, schema).select(
        "tid", F.col("chunk").alias("run"), F.lit(-1).cast("long").alias("chunk"), "state")
    return scans.map_groups(summaries.unionByName(starts, allowMissingColumns=True), ["tid", "run"], ["chunk"], _entries, schema)


def _fold(table: pa.Table, borders: list[int]) -> pa.Table:
    tids, chunks, lasts = scans.lists(table.take(pa.array(borders[:-1], pa.int64())), ["tid", "chunk", "lastChunk"])
    names = [*FRAME_FIELDS, *_COUNT_FIELDS]
    data: dict[str, list] = {name: [] for name in ("tid", "chunk", "n", *names)}
    none = (None,) * len(FRAME_FIELDS)
    for (rows, losses, state), tid, chunk, last in zip(_groups(table, borders), tids, chunks, lasts):
        counters = fold.Counters()
        frames = fold.fold_chunk(rows, losses, fold.unpack_state(state) if state else None, chunk == last, counters)
        count = len(frames)
        # Row 0 carries the chunk's counters, rows 1.. its frames in emission order.
        data["tid"] += [tid] * (count + 1)
        data["chunk"] += [chunk] * (count + 1)
        data["n"] += range(count + 1)
        for name, values in zip(FRAME_FIELDS, zip(none, *frames)):
            data[name] += values
        for name, value in zip(_COUNT_FIELDS, (count, counters.skipped, counters.ignored, counters.resyncs, counters.dropped)):
            data[name] += [value, *[None] * count]
    return pa.table({name: pa.array(values, pa.int64()) for name, values in data.items()})


def fold_branches(branches: DataFrame, locations: DataFrame, losses: DataFrame,
                  chunk_rows: int = scans.CHUNK_ROWS, fan: int = CHUNK_FAN) -> DataFrame:
    """Raw fold output: per (tid, chunk) a counter row (n = 0) and the frames (n = 1..).

    Threads of several chunks are first summarised chunk by chunk, so no task ever holds more than one
    chunk of rows; threads that fit one chunk have nothing to summarise. All take the same path.
    """
    positioned = thread_positions(branches, chunk_rows)
    rows = classify_branches(positioned, locations).select(
        "tid", "chunk", "lastChunk", F.lit(_ROW).alias("tag"), F.col("position").alias("ord"),
        *fold_columns(), _no_state())
    loss_rows = losses_by_chunk(positioned, losses).select(
        "tid", "chunk", "lastChunk", F.lit(_LOSS).alias("tag"),
        *[_fill(name) for name in ("ord", *ROW_FIELDS)], _no_state())
    merged = durable(rows.unionByName(loss_rows))  # read twice: by the summaries of long threads and by the fold

    whole_group = ["tid", "chunk", "lastChunk"]
    order = ["tag", F.col("ord").asc_nulls_last()]
    summaries = scans.map_groups(merged.filter("lastChunk > 0"), whole_group, order, _summarise, _SUMMARY_SCHEMA)
    state_rows = _chunk_states(summaries, fan).select("tid", "chunk", "lastChunk", F.lit(_STATE).alias("tag"),
                               *[F.lit(0).cast("long").alias(name) for name in ("ord", *ROW_FIELDS)],
                               "state")
    return scans.map_groups(merged.unionByName(state_rows), whole_group, order, _fold, _RAW_SCHEMA)


def frame_ids(raw: DataFrame) -> DataFrame:
    """Frames with `frameId`: tids ascending, then emission order. `raw` must be written out."""
    counts = raw.filter("n = 0").select("tid", "chunk", "frames")
    threads = scans.prefix_totals(counts.groupBy("tid").agg(F.sum("frames").alias("frames")),
                                  "tid", "frames", "threadBase").select("tid", "threadBase")
    before = Window.partitionBy("tid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (counts.withColumn("chunkBase", F.coalesce(F.sum("frames").over(before), F.lit(0)))
             .join(threads, "tid")
             .select("tid", "chunk", (F.col("chunkBase") + F.col("threadBase")).alias("base")))
    return (raw.filter("n > 0").join(bases, ["tid", "chunk"])
            .select((F.col("base") + F.col("n")).alias("frameId"), "tid", "depth", "startTime", "endTime",
                    "startTrace", "endTrace", "locationId", "startCpu", "endCpu",
                    F.col("startReason").cast("int").alias("startReason"),
                    F.col("endReason").cast("int").alias("endReason"),
                    F.col("kind").cast("int").alias("kind")))


@dataclass
class Reconstruction:
    """Fold output and what derives from it."""

    classified: DataFrame
    losses: DataFrame
    raw: DataFrame
    chunk_rows: int

    def raw_frames(self) -> DataFrame:
        return frame_ids(self.raw)

    def frames(self) -> DataFrame:
        return normalize_depths(self.raw_frames())

    def summary(self) -> DataFrame:
        return reconstruction_summary(self.classified, self.losses, self.raw, self.chunk_rows)


def reconstruct(branches: DataFrame, locations: DataFrame, losses: DataFrame,
                chunk_rows: int = scans.CHUNK_ROWS, fan: int = CHUNK_FAN) -> Reconstruction:
    raw = durable(fold_branches(branches, locations, losses, chunk_rows, fan))
    return Reconstruction(classify_branches(branches, locations), losses, raw, chunk_rows)


def reconstruct_stacks(branches: DataFrame, locations: DataFrame, losses: DataFrame,
                       chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Frame intervals with raw depths (position in the stack when emitted)."""
    return reconstruct(branches, locations, losses, chunk_rows).raw_frames()


def reconstruction_summary(classified: DataFrame, losses: DataFrame, raw: DataFrame,
                           chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """The run's ten counters as one row."""
    rows = classified.agg(F.count_if("isCall").alias("calls"), F.count_if("isIgnoredCall").alias("ignoredCalls"),
                          F.count_if("isReturn").alias("returns"))
    folded = raw.filter("n = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNT_FIELDS])
    clips = trace_clips(classified, chunk_rows).agg(F.count(F.lit(1)).alias("traceClips"))
    applied = (losses.join(classified.select("tid").distinct(), "tid", "left_semi")
               .agg(F.count(F.lit(1)).alias("lossesApplied")))
    # Four one-row results side by side.
    return (folded.crossJoin(rows).crossJoin(clips).crossJoin(applied)
            .select("frames", "calls", "ignoredCalls", "returns", "skippedReturns", "ignoredReturns",
                    "resyncs", "droppedFrames", "traceClips", "lossesApplied"))
