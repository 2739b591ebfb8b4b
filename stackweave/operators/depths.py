"""Depth normalisation: nesting level of each frame among the frames of its thread and kind.

In start order, a frame closes every open frame that ended by its start and every one that ends
before it does. What stays open is therefore a stack of non-increasing end points, and the
smallest unused depth is its size. That makes the computation splittable: a chunk of consecutive
frames leaves behind the stack of its own frames, of which later chunks keep the entries that
reach at least as far as they do. Joining two stacks that way is associative, so the stacks open
before each chunk come from a two-level scan (`scans.entry_states`) over chunks of bounded rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stackweave.operators import scans

_KEYS = ["tid", "kind"]
_PAIRS = pa.list_(pa.int64())


def frame_order() -> list[Column]:
    """Start ascending, end descending, then id."""
    return [F.col("startTime"), F.col("startTrace"), -F.col("endTime"), -F.col("endTrace"), F.col("frameId")]


def order_frames(frames: DataFrame) -> DataFrame:
    return frames.orderBy(*_KEYS, *frame_order())


def number_frames(frames: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Add `position`: the frame's place in `order_frames`, without a sort of the whole table."""
    return scans.track_numbers(frames, "startTime", frame_order(), "position", chunk_rows)


def _open_frames(ends: Iterable[tuple], stack: list[tuple]) -> tuple[list[int], list[tuple]]:
    """Depths of frames (startTime, startTrace, endTime, endTrace) in order, given the (endTime, endTrace) stack open before them."""
    depths = []
    for start, start_trace, end, end_trace in ends:
        start_at, end_at = (start, start_trace), (end, end_trace)
        while stack and (stack[-1] <= start_at or stack[-1] < end_at):
            stack.pop()
        depths.append(len(stack))
        stack.append(end_at)
    return depths, stack


def _ends(table: pa.Table) -> list[tuple]:
    return list(zip(*scans.lists(table, ["startTime", "startTrace", "endTime", "endTrace"])))


def _local_stacks(table: pa.Table, borders: list[int]) -> pa.Table:
    ends, at = _ends(table), borders[:-1]
    flat = [[v for end in _open_frames(ends[a:b], [])[1] for v in end] for a, b in zip(borders, borders[1:])]
    heads = table.select([*_KEYS, "chunk"]).take(pa.array(at, pa.int64()))
    return heads.append_column("ends", pa.array(flat, _PAIRS))


def _join_stacks(below: list[int] | None, own: list[int]) -> list[int]:
    """The stack left by two stretches of frames; an own stack's bottom entry is the furthest end of its stretch."""
    kept = [v for t, n in zip((below or [])[::2], (below or [])[1::2]) if (t, n) >= (own[0], own[1]) for v in (t, n)]
    return kept + own


def _depths(table: pa.Table, borders: list[int]) -> pa.Table:
    """Frames with their depths; a chunk's open stack is the row before its frames, if there is one."""
    ends, entries = _ends(table), table.column("entry")
    opens = entries.is_valid().to_pylist()
    depths: list[int | None] = []
    for a, b in zip(borders, borders[1:]):
        flat = entries[a].as_py() if opens[a] else []
        first = a + opens[a]
        depths += [None] * (first - a) + _open_frames(ends[first:b], list(zip(flat[::2], flat[1::2])))[0]
    at = table.schema.get_field_index("depth")
    return table.set_column(at, "depth", pa.array(depths, pa.int64())).filter(entries.is_null()).drop_columns(["chunk", "entry"])


def normalize_depths(frames: DataFrame, chunk_rows: int = scans.CHUNK_ROWS, fan: int = scans.FAN) -> DataFrame:
    """Replace `depth` by the nesting level.

    Frames of (tid, kind) are cut along their start into chunks of at most `chunk_rows`; only those of several chunks
    are scanned for the stacks open in between. A chunk is one group of rows in start order.
    """
    columns, on = frames.columns, [*_KEYS, "chunk"]
    cut = scans.time_chunks(frames, _KEYS, "startTime", chunk_rows)
    local = scans.map_groups(cut.filter("chunks > 1").drop("chunks"), on, frame_order(), _local_stacks,
                             "tid long, kind int, chunk long, ends array<long>")
    entries = scans.entry_states(local, _KEYS, "ends", _join_stacks, fan)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema.fields)
    rows = cut.select(*columns, "chunk", F.lit(None).cast("array<long>").alias("entry"))
    opened = entries.select(*[F.col(c) if c in on else F.lit(0).cast(frames.schema[c].dataType).alias(c) for c in columns],
                            "chunk", F.coalesce("entry", F.array().cast("array<long>")).alias("entry"))
    return scans.map_groups(rows.unionByName(opened), on, [F.col("entry").isNull(), *frame_order()], _depths, schema)


def frame_islands(frames: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Add `island`: number of the gap-free run of overlapping frames within (tid, kind)."""
    end = F.struct(F.col("endTime").alias("t"), F.col("endTrace").alias("n"))
    start = F.struct(F.col("startTime").alias("t"), F.col("startTrace").alias("n"))
    cut = scans.time_chunks(frames.withColumn("__end", end).withColumn("__start", start), _KEYS, "startTime", chunk_rows)
    reached = scans.split_running_max(cut, _KEYS, frame_order(), "__end", "__reached", inclusive=False)
    opens = F.coalesce(F.col("__start") >= F.col("__reached"), F.lit(True)).cast("int")
    return (scans.split_running_sum(reached.withColumn("__opens", opens), _KEYS, frame_order(),
                                    "__opens", "island")
            .drop("__end", "__start", "__reached", "__opens", "chunk", "chunks"))
