"""Slice events and tracks of a trace, and checks of their nesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stackweave import schemas as S
from stackweave.functions import scalars as X
from stackweave.operators import scans
from stackweave.operators.branches import thread_positions

MAX_NAME_PARTS = 16
_CLOSING = (S.REASON_RETURN, S.REASON_TRACE_END, S.REASON_AUX_LOSS, S.REASON_END_OF_INPUT)


# ---- endpoints ---------------------------------------------------------------------------

def endpoint_filter(frames: DataFrame) -> DataFrame:
    """Frames whose end is visible."""
    return frames.filter(F.col("endReason").isin(*_CLOSING))


def slice_endpoints(frames: DataFrame, begins: Column | None = None, ends: Column | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """A begin row and, for the closing reasons, an end row per frame; `keep` names more columns."""
    begins = F.lit(True) if begins is None else begins
    ends = F.col("endReason").isin(*_CLOSING) if ends is None else ends
    same_instant = (F.col("startTime") == F.col("endTime")) & (F.col("startTrace") == F.col("endTrace"))

    def point(is_begin: bool, time: str, trace: str, shown: Column) -> Column:
        return F.when(shown, F.struct(F.lit(is_begin).alias("isBegin"), F.col(time).alias("time"),
                                      F.col(trace).alias("trace")))

    points = F.array_compact(F.array(point(True, "startTime", "startTrace", begins),
                                     point(False, "endTime", "endTrace", ends)))
    return (frames.withColumn("isInstant", begins & ends & same_instant)
            .withColumn("p", F.explode(points))
            .select("tid", "kind", "frameId", "depth", "locationId", "p.time", "p.trace", "p.isBegin",
                    "isInstant", *keep))


def endpoint_order() -> list[Column]:
    """Total order within a track: at one (time, trace) first the ends of earlier frames, deepest
    first, then begins of frames that last, outermost first, then frames of no length."""
    phase = F.when(F.col("isInstant"), 2).when(F.col("isBegin"), 1).otherwise(0)
    level = F.when(~F.col("isBegin") & ~F.col("isInstant"), -F.col("depth")).otherwise(F.col("depth"))
    return [F.col("time"), F.col("trace"), phase, level, F.col("frameId"), F.when(F.col("isBegin"), 0).otherwise(1)]


def order_slice_endpoints(endpoints: DataFrame, *keys: str) -> DataFrame:
    return endpoints.orderBy(*keys, *endpoint_order())


def number_slice_endpoints(endpoints: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Add `position`: the endpoint's place in `order_slice_endpoints` by tid and kind, without a sort of the whole table."""
    return scans.track_numbers(endpoints, "time", endpoint_order(), "position", chunk_rows)


# ---- names -------------------------------------------------------------------------------

def _path_order() -> Column:
    return F.col("pid").cast("string")


def thread_info(branches: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Per thread: first pid in path order and the thread name."""
    pids = branches.groupBy("tid").agg(F.min_by("pid", _path_order()).alias("pid"))
    return pids.join(thread_comm_chain(branches, chunk_rows), "tid")


def thread_comm_chain(branches: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Command names of a thread in order, repeats collapsed, at most 16, joined with ` -> `.

    Every chunk first reduces itself to its leading distinct runs; a chunk with more than 16 runs
    already decides the name, so longer tails cannot matter.
    """
    comm = F.coalesce(F.nullif("ipComm", F.lit("")), F.nullif("addressComm", F.lit("")))
    rows = thread_positions(branches, chunk_rows).select("tid", "chunk", "position", comm.alias("comm"))
    chunk = Window.partitionBy("tid", "chunk").orderBy("position")
    thread = Window.partitionBy("tid").orderBy("position")

    def runs(df: DataFrame, window) -> DataFrame:
        return (df.withColumn("before", F.lag("comm").over(window))
                .filter(F.col("before").isNull() | (F.col("before") != F.col("comm")))
                .withColumn("rank", F.row_number().over(window)))

    leading = runs(rows.filter(F.col("comm").isNotNull()), chunk).filter(F.col("rank") <= MAX_NAME_PARTS + 1)
    # A chunk of r runs adds at least r - 1 names; chunks after enough names cannot add any.
    changes = leading.groupBy("tid", "chunk").agg((F.max("rank") - 1).alias("changes"))
    before = Window.partitionBy("tid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    needed = (changes.withColumn("so_far", F.coalesce(F.sum("changes").over(before), F.lit(0)))
              .filter(F.col("so_far") < MAX_NAME_PARTS).select("tid", "chunk"))
    leading = leading.join(needed, ["tid", "chunk"])
    chain = runs(leading.drop("before", "rank"), thread).filter(F.col("rank") <= MAX_NAME_PARTS)
    names = chain.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("rank", "comm"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["comm"]), " -> ")
    return (branches.select("tid").distinct().join(names, "tid", "left")
            .select("tid", F.coalesce(joined, F.concat(F.lit("Thread "), F.col("tid").cast("string")))
                    .alias("threadName")))


def collapse_consecutive(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Drop rows whose value equals the preceding row's. `rows` carries a `chunk` column."""
    stepped = scans.split_lag(rows, keys, order, [value], "__previous")
    kept = F.col("__previous").isNull() | ~F.col(f"__previous.{value}").eqNullSafe(F.col(value))
    return stepped.filter(kept).drop("__previous")


def fallback_names(branches: DataFrame) -> DataFrame:
    """First non-empty sample symbol per location id: threads ascending, then row order."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("ipLocationId").alias("locationId"),
                             F.col("ipSym").alias("sym")),
                    F.struct(F.lit(1).alias("side"), F.col("addressLocationId").alias("locationId"),
                             F.col("addressSym").alias("sym")))
    seen = (branches.select("tid", _path_order().alias("path"), "id", F.explode(sides).alias("e"))
            .select("tid", "path", "id", "e.*").filter((F.col("locationId") != 0) & ~X.is_empty("sym")))
    return seen.groupBy("locationId").agg(
        F.min_by("sym", F.struct("tid", "path", "id", "side")).alias("fallbackName"))


def join_frame_names(frames: DataFrame, locations: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Display name and source location of each frame."""
    shown = locations.select(
        F.col("id").alias("locationId"),
        X.display_name("symbol", "sourceFileName", "sourceLineNumber", "dso", "relativeAddress").alias("display"),
        X.source_location_struct("symbol", "sourceFileName", "sourceLineNumber").alias("sourceLocation"))
    return (frames.join(shown, "locationId", "left").join(fallbacks, "locationId", "left")
            .withColumn("name", X.event_name("locationId", "display", "fallbackName"))
            .withColumn("sourceLocation", F.when(F.col("locationId") != 0, F.col("sourceLocation")))
            .drop("display", "fallbackName"))


def join_thread_info(frames: DataFrame, info: DataFrame) -> DataFrame:
    """Pid and thread name per frame; a thread without samples is pid 0, `Thread <tid>`."""
    unnamed = F.concat(F.lit("Thread "), F.col("tid").cast("string"))
    return (frames.join(info, "tid", "left")
            .withColumn("pid", F.coalesce("pid", F.lit(0).cast("long")))
            .withColumn("threadName", F.coalesce("threadName", unnamed)))


# ---- export ------------------------------------------------------------------------------

_EVENT = ["section", "pid", "tid", "kind", "event", "timestamp", "trackUuid", "parentUuid", "name",
          "function", "file", "line", "sequenceId", "trace", "phase", "level", "frameId"]
_EVENT_TYPES = {"section": "int", "kind": "int", "event": "string", "name": "string",
                "function": "string", "file": "string", "phase": "int"}


def _events(df: DataFrame, section: int, event: Column | str, **columns: Column) -> DataFrame:
    given = {"section": F.lit(section), "event": F.lit(event) if isinstance(event, str) else event, **columns}
    return df.select(*[(given[c] if c in given else F.lit(None)).cast(_EVENT_TYPES.get(c, "long")).alias(c)
                       for c in _EVENT])


def trace_events(frames: DataFrame, branches: DataFrame, locations: DataFrame,
                 losses: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """All tracks, loss markers and slices as rows, unordered; `order_trace_events` sorts them."""
    info = thread_info(branches) if info is None else info
    col = F.col
    tracks = frames.select("tid", "kind").distinct()
    threads = join_thread_info(
        info.select("tid").unionByName(tracks.select("tid")).distinct(), info)
    stacks = join_thread_info(tracks, info)
    named = join_frame_names(frames, locations, fallback_names(branches))
    pids = info.select("tid", "pid")
    slices = (slice_endpoints(named, keep=("name", "sourceLocation")).join(pids, "tid", "left")
              .withColumn("pid", F.coalesce("pid", F.lit(0).cast("long"))))
    stack_id = X.stack_track("pid", "tid", "kind")
    begin = col("isBegin")
    return reduce(lambda left, right: left.unionByName(right), [
        _events(threads.select("pid").distinct(), 0, "process", pid=col("pid"),
                trackUuid=X.process_track("pid"), name=X.process_name("pid")),
        _events(threads, 1, "thread", pid=col("pid"), tid=col("tid"), name=col("threadName"),
                trackUuid=X.thread_track("pid", "tid"), parentUuid=X.process_track("pid")),
        _events(losses.agg(F.count(F.lit(1)).alias("n")).filter("n > 0"), 2, "track",
                trackUuid=F.lit(X.LOSS_TRACK), name=F.lit("AUX loss")),
        _events(losses, 3, "instant", timestamp=col("time"), trace=col("id"), trackUuid=F.lit(X.LOSS_TRACK),
                name=X.loss_marker_name("tid", "cpu", "flags"), sequenceId=X.sequence_id(F.lit(X.LOSS_TRACK))),
        _events(stacks, 4, "stack", pid=col("pid"), tid=col("tid"), kind=col("kind"), phase=F.lit(-1),
                name=X.stack_track_name("threadName", "kind"), trackUuid=stack_id,
                parentUuid=X.thread_track("pid", "tid")),
        _events(slices, 4, F.when(begin, "begin").otherwise("end"), pid=col("pid"), tid=col("tid"),
                kind=col("kind"), timestamp=col("time"), trackUuid=stack_id, name=F.when(begin, col("name")),
                function=F.when(begin, col("sourceLocation.function")),
                file=F.when(begin, col("sourceLocation.file")),
                line=F.when(begin, col("sourceLocation.line")), sequenceId=X.sequence_id(stack_id),
                trace=col("trace"), phase=endpoint_order()[2], level=endpoint_order()[3], frameId=col("frameId")),
    ])


def order_trace_events(events: DataFrame) -> DataFrame:
    """Sections in turn; tracks by (pid, tid); each stack track before its slices in slice order."""
    pid_first = F.when(F.col("section") < 4, F.col("pid"))
    return events.orderBy("section", pid_first, "tid", "kind", F.when(F.col("phase") == -1, 0).otherwise(1),
                          F.when(F.col("section") == 4, F.col("timestamp")), "trace", "phase", "level",
                          "frameId", "event")


def trace_event_export(frames: DataFrame, branches: DataFrame, locations: DataFrame,
                       losses: DataFrame) -> DataFrame:
    return order_trace_events(trace_events(frames, branches, locations, losses))


# ---- nesting checks ----------------------------------------------------------------------

def _visible_endpoints(frames: DataFrame) -> DataFrame:
    """Endpoints of the strict check: resumed begins and ends other than returns do not count."""
    return slice_endpoints(frames, F.col("startReason") != S.REASON_TRACE_RESUME,
                           F.col("endReason") == S.REASON_RETURN)


def _open_counts(endpoints: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """Add `open`: frames open after each endpoint of the key, over chunks of time."""
    cut = scans.time_chunks(endpoints.withColumn("delta", F.when(F.col("isBegin"), 1).otherwise(-1)), keys, "time", chunk_rows)
    return scans.split_running_sum(cut, keys, endpoint_order(), "delta", "open")


def max_open_frames(frames: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Per thread the most frames open at once. A chunk's sum and highest point say all: no second look at its rows."""
    keys = ["tid"]
    cut = scans.time_chunks(_visible_endpoints(frames).withColumn("delta", F.when(F.col("isBegin"), 1).otherwise(-1)), keys, "time", chunk_rows)
    within = Window.partitionBy(*keys, "chunk").orderBy(*endpoint_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peaks = (cut.withColumn("inside", F.sum("delta").over(within)).groupBy(*keys, "chunk")
             .agg(F.max("inside").alias("peak"), F.sum("delta").alias("total")))
    carried = scans.carried_sum(peaks, keys, "total", "before")
    return carried.groupBy(*keys).agg(F.max(F.col("before") + F.col("peak")).alias("maxOpen"))


def check_well_nested(frames: DataFrame, limit: int = 512, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Per thread: ends that do not close the innermost open frame, and the open-frame limit.

    An end that leaves n frames open must belong to the last frame that was opened as number
    n + 1; that frame is carried from chunk to chunk per (thread, level).
    """
    counted = _open_counts(_visible_endpoints(frames), ["tid"], chunk_rows)
    level = F.when(F.col("isBegin"), F.col("open")).otherwise(F.col("open") + 1)
    leveled = (counted.withColumn("openLevel", level)
               .withColumn("begun", F.when(F.col("isBegin"), F.col("frameId"))))
    paired = scans.split_last(leveled, ["tid", "openLevel"], endpoint_order(), "begun", "innermost")
    wrong = ~F.col("isBegin") & ((F.col("openLevel") <= 0) | ~F.col("innermost").eqNullSafe(F.col("frameId")))
    return paired.groupBy("tid").agg(F.count_if(wrong).alias("violations"), F.max("open").alias("maxOpen")).select(
        "tid", "violations", "maxOpen", (F.col("maxOpen") >= limit).alias("overLimit"))


def check_visible_depths(frames: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Endpoints whose depth, less the depth at the last empty point, is not the open count."""
    keys = ["tid", "kind"]
    counted = _open_counts(slice_endpoints(frames), keys, chunk_rows)
    opened = F.col("isBegin") & (F.col("open") == 1)
    based = scans.split_last(counted.withColumn("base", F.when(opened, F.col("depth"))),
                             keys, endpoint_order(), "base", "baseDepth")
    above = F.col("depth") >= F.col("baseDepth")
    return (based.withColumn("visibleDepth", F.when(above, F.col("depth") - F.col("baseDepth"))
                             .otherwise(F.col("depth")))
            .withColumn("openBelow", F.when(F.col("isBegin"), F.col("open") - 1).otherwise(F.col("open")))
            .filter(F.col("visibleDepth") != F.col("openBelow"))
            .select(*keys, "frameId", "isBegin", "time", "trace", "depth", "visibleDepth", "openBelow"))


def first_frames_per_symbol(frames: DataFrame, top: int = 12) -> DataFrame:
    """The earliest frames of each wanted symbol (a `symbol` column); ties by frame id.

    The rank filter limits every partition to `top` rows per symbol before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("startTime", "frameId"))
    return frames.withColumn("rank", rank).filter(F.col("rank") <= top)
