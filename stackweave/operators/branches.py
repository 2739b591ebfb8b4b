"""Branch rows: thread order, function identity, call/return classes, loss epochs, trace clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stackweave import schemas as S
from stackweave.functions import scalars as X
from stackweave.operators import scans


# ---- function identity -------------------------------------------------------------------

def function_entries(locations: DataFrame) -> DataFrame:
    """Lowest known address of every function, i.e. of every non-empty (dso, symbol)."""
    return (locations.filter(~X.is_empty("dso") & ~X.is_empty("symbol"))
            .groupBy("dso", "symbol").agg(F.min("relativeAddress").alias("entryAddress"),
                                          F.min("id").alias("functionId")))


def function_index(locations: DataFrame) -> DataFrame:
    """Narrow dimension for the branch joins: location id -> function id and three flags.

    The function id is the lowest location id of the function, so equality of ids is equality
    of (dso, symbol). A location without a full name is its own function, marked by the sign.
    """
    entries = function_entries(locations)
    return (locations.select("id", "dso", "symbol", "relativeAddress")
            .join(entries, ["dso", "symbol"], "left")
            .select(
                F.col("id").alias("locationId"),
                F.coalesce("functionId", -F.col("id")).alias("functionId"),
                F.coalesce(F.col("relativeAddress") == F.col("entryAddress"), F.lit(False)).alias("isEntry"),
                (~X.is_empty("symbol")).alias("hasSymbol"),
                F.coalesce(F.col("symbol") == "main", F.lit(False)).alias("isMain")))


def join_function_entries(branches: DataFrame, locations: DataFrame) -> DataFrame:
    """Entry address of the target's function, next to the target's own address."""
    target = (locations.join(function_entries(locations), ["dso", "symbol"], "left")
              .select(F.col("id").alias("addressLocationId"), "relativeAddress", "entryAddress"))
    return (branches.join(target, "addressLocationId", "left")
            .withColumn("isEntry", F.coalesce(F.col("relativeAddress") == F.col("entryAddress"), F.lit(False))))


def join_branch_locations(branches: DataFrame, locations: DataFrame) -> DataFrame:
    """Dso, symbol and address of both ends; a missing location leaves nulls."""
    pruned = locations.select("id", "dso", "symbol", "relativeAddress")

    def end(prefix: str, key: str) -> DataFrame:
        return pruned.select(F.col("id").alias(key), F.col("dso").alias(f"{prefix}Dso"),
                             F.col("symbol").alias(f"{prefix}Symbol"),
                             F.col("relativeAddress").alias(f"{prefix}Relative"))

    return (branches.join(end("ip", "ipLocationId"), "ipLocationId", "left")
            .join(end("address", "addressLocationId"), "addressLocationId", "left"))


def same_function() -> Column:
    """Both sides named and equal (over the columns of `join_branch_locations`)."""
    named = ~X.is_empty("ipDso") & ~X.is_empty("ipSymbol")
    equal = (F.col("ipDso") == F.col("addressDso")) & (F.col("ipSymbol") == F.col("addressSymbol"))
    return F.coalesce(named & equal, F.lit(False))


def with_functions(branches: DataFrame, locations: DataFrame) -> DataFrame:
    """Function ids and flags of both ends, by two narrow left joins."""
    index = function_index(locations)
    ip = index.select(F.col("locationId").alias("ipLocationId"), F.col("functionId").alias("ipFunction"),
                      F.col("hasSymbol").alias("ipHasSymbol"), F.col("isMain").alias("ipIsMain"))
    target = index.select(F.col("locationId").alias("addressLocationId"),
                          F.col("functionId").alias("addressFunction"),
                          F.col("isEntry").alias("targetIsEntry"), F.col("isMain").alias("addressIsMain"))
    false = F.lit(False)
    return (
        branches.join(ip, "ipLocationId", "left").join(target, "addressLocationId", "left")
        .withColumn("ipFunction", F.coalesce("ipFunction", -F.col("ipLocationId")))
        .withColumn("addressFunction", F.coalesce("addressFunction", -F.col("addressLocationId")))
        .withColumn("ipHasSymbol", F.coalesce("ipHasSymbol", false))
        .withColumn("ipIsMain", F.coalesce("ipIsMain", false))
        .withColumn("addressIsMain", F.coalesce("addressIsMain", false))
        .withColumn("targetIsEntry", F.coalesce("targetIsEntry", false))
        .withColumn("sameFunction", (F.col("ipFunction") > 0) & (F.col("ipFunction") == F.col("addressFunction")))
        .withColumn("sameFunctionById", F.col("ipFunction") == F.col("addressFunction"))
    )


def classify_branches(branches: DataFrame, locations: DataFrame) -> DataFrame:
    """Add isCall, isReturn, isStackCall, isIgnoredCall and kind."""
    def flag(bit: int) -> Column:
        return F.col("flags").bitwiseAND(F.lit(bit)) != 0

    same, entry = F.col("sameFunction"), F.col("targetIsEntry")
    return (
        with_functions(branches, locations)
        .withColumn("isCall", flag(S.FLAG_CALL) | (~same & entry))
        .withColumn("isStackCall", ~same | entry)
        .withColumn("isReturn", ~F.col("isCall") & (flag(S.FLAG_RETURN) | (~same & ~entry)))
        .withColumn("isIgnoredCall", F.col("isCall") & ~F.col("isStackCall"))
        .withColumn("kind", X.stack_kind("cpumode"))
    )


# ---- thread order ------------------------------------------------------------------------

def thread_positions(branches: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Add `position` in the thread (pids in path order, then id), `chunk` and `lastChunk`.

    Ids are dense per (pid, tid), so a chunk is at most `chunk_rows` consecutive rows; the only
    per-thread work is a scan over one row per pid.
    """
    sizes = branches.groupBy("tid", "pid").agg(F.max("id").alias("__size"))
    by_path = Window.partitionBy("tid").orderBy(F.col("pid").cast("string"))
    before = by_path.rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "tid", "pid", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"),
        scans.whole(F.sum("__size").over(Window.partitionBy("tid")), chunk_rows).alias("lastChunk"))
    return (branches.join(bases, ["tid", "pid"])
            .withColumn("position", F.col("__base") + F.col("id")).drop("__base")
            .withColumn("chunk", scans.whole(F.col("position"), chunk_rows)))


# ---- losses ------------------------------------------------------------------------------

def losses_by_chunk(positioned: DataFrame, losses: DataFrame, most: int = scans.CHUNK_ROWS) -> DataFrame:
    """The chunk in which each loss takes effect; losses of threads without rows drop out.

    `positioned` comes from `thread_positions`; only tid, chunk, lastChunk and time are read.

    A loss is applied before the first row such that some row up to it has a later time. The running maximum over chunk
    maxima gives each chunk a mark; marks and losses are merged backwards in time by common splitters, so that the losses of
    one thread spread over tasks. After a thread's last row a second loss changes nothing more: only the first is given.
    """
    peaks = positioned.groupBy("tid", "chunk").agg(F.max("time").alias("peak"),
                                                 F.max("lastChunk").alias("lastChunk"))
    marks = scans.carried_max(peaks, ["tid"], "peak", "at").select(
        "tid", "at", F.lit(0).alias("isLoss"), F.col("chunk").alias("mark"), F.lit(None).cast("long").alias("lossCpu"))
    events = marks.unionByName(losses.select(
        "tid", F.col("time").alias("at"), F.lit(1).alias("isLoss"),
        F.lit(None).cast("long").alias("mark"), F.col("cpu").alias("lossCpu"))).withColumn("back", -F.col("at"))
    cut = scans.time_chunks(events, ["tid"], "back", most)
    found = scans.split_last(cut, ["tid"], ["back", -F.col("isLoss"), -F.col("mark")], "mark", "target").filter("isLoss = 1")
    inside = found.filter("target is not null").select("tid", F.col("target").alias("chunk"), F.col("at").alias("lossTime"), "lossCpu")
    trailing = (found.filter("target is null").groupBy("tid").agg(F.min(F.struct(F.col("at").alias("lossTime"), "lossCpu")).alias("l"))
                .select("tid", F.lit(None).cast("long").alias("chunk"), "l.lossTime", "l.lossCpu"))
    ends = peaks.groupBy("tid").agg(F.max("lastChunk").alias("lastChunk"))
    return (inside.unionByName(trailing).join(ends, "tid")
            .select("tid", F.coalesce("chunk", "lastChunk").alias("chunk"), "lastChunk", "lossTime", "lossCpu"))


def assign_loss_epoch(branches: DataFrame, losses: DataFrame,
                      chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Add `epoch`: how many of the thread's losses were applied before the row.

    A row's place among the losses is its latest time so far. Rows and losses are cut by common splitters, counted from
    both tables' times, and merged chunk by chunk. (Rows behind one bogus late time share their place, so they stay together.)
    """
    rows = scans.split_running_max(thread_positions(branches, chunk_rows), ["tid"], ["position"],
                                   "time", "reached").drop("chunk", "lastChunk")
    merged = rows.withColumn("isLoss", F.lit(0)).unionByName(losses.select(
        "tid", F.col("time").alias("reached"), F.lit(1).alias("isLoss")), allowMissingColumns=True)
    splitters = scans.time_splitters(branches.select("tid", "time").unionByName(losses.select("tid", "time")), ["tid"], "time", chunk_rows)
    cut = scans.time_chunks(merged, ["tid"], "reached", chunk_rows, splitters)
    counted = scans.split_running_sum(cut, ["tid"], ["reached", "isLoss", "position"], "isLoss", "epoch")
    return counted.filter(F.col("isLoss") == 0).drop("isLoss", "reached", "chunk", "chunks", "position")


# ---- trace clips -------------------------------------------------------------------------

def trace_clips(classified: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Rows that end an active trace. Ignored calls do not get as far as their end flag."""
    begins = F.col("flags").bitwiseAND(F.lit(S.FLAG_TRACE_BEGIN)) != 0
    ends = (F.col("flags").bitwiseAND(F.lit(S.FLAG_TRACE_END)) != 0) & ~F.col("isIgnoredCall")
    moves = (thread_positions(classified, chunk_rows).withColumn("begins", begins)
             .withColumn("ends", ends).filter(F.col("begins") | F.col("ends")))
    stepped = scans.split_lag(moves, ["tid"], ["position"], ["ends"], "previous")
    inactive = F.coalesce(F.col("previous.ends"), F.lit(False)) & ~F.col("begins")
    return stepped.filter(F.col("ends") & ~inactive).drop("chunk", "lastChunk", "position", "previous")
