"""Comparison of reconstructed frames with a profiler's sampled stacks."""

from __future__ import annotations

from heapq import heappop, heappush

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stackweave.functions import scalars as X
from stackweave.operators import frame_sweep as sweep, scans
from stackweave.session import durable

TOLERANCE_NS = 5_000_000
# Chunks of a busy symbol begin at multiples of this power of two (about 65 us).
GRAIN_BITS = 16


# ---- frames per wanted symbol --------------------------------------------------------------

def symbol_matches(locations: DataFrame, wanted: DataFrame, most: int = 1 << 16, spread: int = 64) -> DataFrame:
    """(locationSymbol, symbol) for each wanted symbol that a location symbol matches: `main` exactly, others as a substring.

    The wanted symbols are compiled into automata of at most about `most` symbols each, and every distinct location
    symbol runs once through each automaton: the cost is linear in its length, whatever the number and lengths of the wanted ones.
    Location symbols are spread over `spread` groups per automaton by their hash.
    """
    wanted = wanted.select("symbol").filter(F.col("symbol").isNotNull()).distinct()
    parts = wanted.agg(F.greatest(F.ceil(F.count(F.lit(1)) / most), F.lit(1)).cast("int")).scalar()
    keys = ["part", "salt"]
    names = (locations.filter(~X.is_empty("symbol")).select(F.col("symbol").alias("locationSymbol")).distinct()
             .withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("salt", F.pmod(F.hash("locationSymbol"), F.lit(spread))).drop("parts"))
    dealt = (wanted.withColumn("parts", parts).withColumn("part", F.pmod(F.hash("symbol"), F.col("parts")))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).drop("parts"))

    def matches(names: pa.Table, symbols: pa.Table) -> pa.Table:
        automaton, always, exact = ahocorasick.Automaton(), [], False
        for symbol in symbols.column("symbol").to_pylist():
            if symbol == "main":
                exact = True
            elif symbol == "":
                always.append(symbol)
            else:
                automaton.add_word(symbol, symbol)
        automaton.make_automaton()
        rows = []
        for name in names.column("locationSymbol").to_pylist():
            found = {symbol for _, symbol in automaton.iter(name)} if len(automaton) else set()
            rows += [(name, symbol) for symbol in [*found, *always, *(["main"] if exact and name == "main" else [])]]
        return pa.table({"locationSymbol": pa.array([r[0] for r in rows], pa.string()), "symbol": pa.array([r[1] for r in rows], pa.string())})

    return names.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(matches, "locationSymbol string, symbol string")


def frames_by_symbol(frames: DataFrame, locations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames once per wanted symbol that matches their location's symbol."""
    named = (locations.select(F.col("id").alias("locationId"), F.col("symbol").alias("locationSymbol"))
             .join(symbol_matches(locations, wanted), "locationSymbol")
             .select("locationId", "symbol"))
    return frames.join(named, "locationId")


def symbol_frame_stats(by_symbol: DataFrame, wanted: DataFrame) -> DataFrame:
    stats = by_symbol.groupBy("symbol").agg(F.count(F.lit(1)).alias("frames"), F.max("depth").alias("maxDepth"))
    return wanted.select("symbol").distinct().join(stats, "symbol", "left").select(
        "symbol", F.coalesce("frames", F.lit(0)).alias("frames"), "maxDepth")


# ---- time containment ----------------------------------------------------------------------

def _padded(frames: DataFrame, tolerance: int) -> DataFrame:
    return (frames.withColumn("lo", F.greatest(F.col("startTime") - tolerance, F.lit(0)))
            .withColumn("hi", F.col("endTime") + tolerance))


def _shift(value: Column, bits: Column) -> Column:
    # The bit count is a column, which only the SQL spelling accepts.
    return F.call_function("shiftright", value, bits.cast("int"))


def file_order() -> Column:
    """Order of equal candidates: the order frames are written in."""
    return F.struct("tid", "kind", "startTime", "startTrace", (-F.col("endTime")).alias("e"),
                    (-F.col("endTrace")).alias("n"), "frameId")


def _whole_blocks(first: Column, past: Column) -> Column:
    """Aligned power-of-two blocks (level, block) that make up the chunks from `first` to before `past`, at most two per level."""
    def blocks_at(level: Column) -> Column:
        from_block = _shift(first + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        to_block = _shift(past, level)
        some = from_block < to_block
        none = F.lit(None).cast("struct<level:int,block:bigint>")
        left = F.when(some & (from_block % 2 == 1), F.struct(level.alias("level"), from_block.alias("block")))
        right = F.when(some & (to_block % 2 == 1), F.struct(level.alias("level"), (to_block - 1).alias("block")))
        return F.array(F.coalesce(left, none), F.coalesce(right, none))

    levels = F.sequence(F.lit(0), F.length(F.conv((past - first).cast("string"), 10, 2)))
    return F.array_compact(F.flatten(F.transform(levels, blocks_at)))


def _winners(table: pa.Table, borders: list[int]) -> pa.Table:
    """(point row, best interval) of chunks: intervals come first, best first, then the points by time."""
    interval = table.column("sampleId").is_null().to_numpy().tolist()
    lows, highs = scans.lists(table, ["lo", "hi"])
    won, at = [], []
    for a, b in zip(borders, borders[1:]):
        points = a + sum(interval[a:b])
        starts = sorted(range(a, points), key=lows.__getitem__)
        opened, begun, count = [], 0, points - a
        for row in range(points if count else b, b):
            time = lows[row]
            while begun < count and lows[starts[begun]] <= time:
                heappush(opened, starts[begun])
                begun += 1
            while opened and highs[opened[0]] < time:
                heappop(opened)
            if opened:
                won.append(opened[0])
                at.append(row)
    found = table.take(pa.array(at, pa.int64())).drop_columns(["chunk", "lo", "hi", "best"])
    return found.append_column("best", table.column("best").take(pa.array(won, pa.int64())))


def _first_holding(points: DataFrame, intervals: DataFrame, keys: list[str], grain_bits: int, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """(sampleId, keys, best): of the intervals (keys, lo, hi, best) that hold a point's time, the smallest `best`.

    The time of a key with more than `chunk_rows` points and interval ends is cut into chunks, at multiples of 2^`grain_bits` ns.
    An interval goes to the chunks of its two ends. Those in between it covers whole: each keeps one best of all intervals that
    do, found by aligned blocks of chunks, so the rows do not grow with an interval's length. Chunks are swept in time order
    with a heap of open intervals: no pairs are formed.
    """
    at = points.filter("sampleId is not null and time is not null").select("sampleId", *keys, "time")
    ends = intervals.select(*keys, F.explode(F.array("lo", "hi")).alias("time"))
    splitters = scans.time_splitters(at.select(*keys, "time").unionByName(ends), keys, "time", chunk_rows, grain_bits)

    def chunked(df: DataFrame, time: str, chunk: str) -> DataFrame:
        return scans.time_chunks(df, keys, time, chunk_rows, splitters).withColumnRenamed("chunk", chunk)

    placed = chunked(chunked(intervals, "lo", "from").drop("chunks"), "hi", "to")
    empty = F.lit(None).cast(points.schema["sampleId"].dataType).alias("sampleId")
    edges = placed.select(*keys, F.explode(F.array_distinct(F.array("from", "to"))).alias("chunk"), empty, "lo", "hi", "best")
    crossing = placed.filter(F.col("to") - F.col("from") > 1).select(
        *keys, F.explode(_whole_blocks(F.col("from") + 1, F.col("to"))).alias("b"), "best")
    covers = (crossing.groupBy(*keys, "b").agg(F.min("best").alias("best"))
              .withColumn("size", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b.level")))
              .select(*keys, F.explode(F.sequence(F.col("b.block") * F.col("size"), (F.col("b.block") + 1) * F.col("size") - 1)).alias("chunk"), "best")
              .groupBy(*keys, "chunk").agg(F.min("best").alias("best"))
              .select(*keys, "chunk", empty, F.lit(-(1 << 63)).alias("lo"), F.lit((1 << 63) - 1).alias("hi"), "best"))
    asked = chunked(at, "time", "chunk").select(*keys, "chunk", "sampleId", F.col("time").alias("lo"), F.col("time").alias("hi"),
                                                F.lit(None).cast(intervals.schema["best"].dataType).alias("best"))
    kind = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join(f"{c} {kind[c]}" for c in [*keys, "sampleId", "best"])
    won = scans.map_groups(edges.unionByName(covers).unionByName(asked), [*keys, "chunk"],
                           [F.col("sampleId").isNotNull(), "best", "lo"], _winners, schema)
    return won.groupBy("sampleId", *keys).agg(F.min("best").alias("best"))


def sample_frame_containment(samples: DataFrame, by_symbol: DataFrame, tolerance: int = TOLERANCE_NS,
                             grain_bits: int = GRAIN_BITS) -> DataFrame:
    """Per (sampleId, symbol): the frame whose padded interval holds the time; lowest depth, then start."""
    best = F.struct("depth", "startTime", file_order().alias("file"))
    frames = _padded(by_symbol, tolerance).select("symbol", "lo", "hi", best.alias("best"))
    won = _first_holding(samples, frames, ["symbol"], grain_bits)
    file = "best.file."
    return won.select("sampleId", "symbol", F.col(file + "frameId").alias("frameId"), F.col(file + "tid").alias("tid"),
                      F.col(file + "kind").alias("kind"), "best.depth", "best.startTime",
                      (-F.col(file + "e")).alias("endTime"), F.col(file + "startTrace").alias("startTrace"),
                      (-F.col(file + "n")).alias("endTrace"))


# ---- nesting -------------------------------------------------------------------------------

def _enclosed(by_symbol: DataFrame, pairs: DataFrame, thread: list[str], sign: int, chunk_rows: int) -> DataFrame:
    """(base, asking) symbol pairs of which some asking frame finds a base frame.

    With sign 1 the base frames are parents: of those begun by the asking frame's start the furthest end must reach its
    end, at a smaller depth. With sign -1 they are children: of those begun at or after its start the nearest end must
    not pass its end, at a greater depth, which is the same search on mirrored axes of time and depth.

    Per base symbol, chunks of time are swept in start order (`frame_sweep.overlapping`), keeping the furthest end per depth;
    those of all earlier chunks come from a two-level scan.
    """
    deepest = by_symbol.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long")).scalar()

    def mirrored(symbol: str) -> DataFrame:
        level = F.col("depth") if sign == 1 else deepest - F.col("depth")
        return by_symbol.select(F.col("symbol").alias(symbol), *thread, level.cast("long").alias("level"),
                                *[(F.col(c) * sign).cast("long").alias(c) for c in ("startTime", "startTrace", "endTime", "endTrace")])

    start, end = ["startTime", "startTrace"], F.struct("endTime", "endTrace")
    owner = ["base", *thread]
    columns = [*owner, "asking", "level", *start, "endTime", "endTrace"]
    own = mirrored("base").join(pairs.select("base").distinct(), "base", "left_semi").withColumn("asking", F.lit(None).cast("string"))
    # Of frames with one start and depth, only the easiest end matters.
    asked = mirrored("asking").groupBy("asking", *thread, "level", *start).agg(F.min(end).alias("end")).select(
        "asking", *thread, "level", *start, "end.*").join(pairs, "asking")
    cut = scans.time_chunks(own.select(*columns).unionByName(asked.select(*columns)), owner, "startTime", chunk_rows)
    on, kinds = [*owner, "chunk"], "base string, " + ("tid long, " if thread else "")

    def furthest(table: pa.Table, borders: list[int]) -> pa.Table:
        rows = list(zip(*scans.lists(table, ["level", "endTime", "endTrace"])))
        is_own = table.column("asking").is_null().to_numpy().tolist()
        ends = [sweep.furthest_ends([r for r, mine in zip(rows[a:b], is_own[a:b]) if mine]) for a, b in zip(borders, borders[1:])]
        return table.select(on).take(pa.array(borders[:-1], pa.int64())).append_column("ends", pa.array(ends, pa.list_(pa.int64())))

    def overlapping(table: pa.Table, borders: list[int]) -> pa.Table:
        rows, entries = list(zip(*scans.lists(table, ["asking", "level", "endTime", "endTrace"]))), table.column("entry")
        opens, at, found = entries.is_valid().to_numpy().tolist(), [], []
        for a, b in zip(borders, borders[1:]):
            symbols = sweep.overlapping(rows[a + opens[a]:b], entries[a].as_py() if opens[a] else [])
            at += [a] * len(symbols)
            found += symbols
        return pa.table({"base": table.column("base").take(pa.array(at, pa.int64())), "asking": pa.array(found, pa.string())})

    local = scans.map_groups(cut.filter("chunks > 1").drop("chunks"), on, [], furthest, f"{kinds}chunk long, ends array<long>")
    entries = scans.entry_states(local, owner, "ends", sweep.join_ends)
    opened = entries.select(*on, F.coalesce("entry", F.array().cast("array<long>")).alias("entry"), F.lit(None).cast("string").alias("asking"),
                            *[F.lit(0).cast("long").alias(c) for c in columns if c not in (*owner, "asking")])
    rows = cut.drop("chunks").withColumn("entry", F.lit(None).cast("array<long>"))
    order = [F.col("entry").isNull(), *start, F.col("asking").isNotNull()]
    return scans.map_groups(rows.unionByName(opened), on, order, overlapping, "base string, asking string").distinct()


def nested_overlap(by_symbol: DataFrame, pairs: DataFrame, same_thread: bool = False, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """For each (parent, child) symbol pair: does some shallower parent frame enclose a child frame?

    Per pair the symbol with fewer frames asks, the other's frames enter once for all its pairs. Rows are frames and
    asking frames; no frame pairs are formed.
    """
    thread = ["tid"] if same_thread else []
    sizes = by_symbol.groupBy("symbol").agg(F.count(F.lit(1)).alias("frames"))
    pairs = pairs.select("parent", "child").distinct()
    sized = durable(pairs.join(sizes.select(F.col("symbol").alias("parent"), F.col("frames").alias("parents")), "parent")
                    .join(sizes.select(F.col("symbol").alias("child"), F.col("frames").alias("children")), "child"))
    few_children = sized.filter("children <= parents").select(F.col("parent").alias("base"), F.col("child").alias("asking"))
    few_parents = sized.filter("children > parents").select(F.col("child").alias("base"), F.col("parent").alias("asking"))
    hits = (_enclosed(by_symbol, few_children, thread, 1, chunk_rows)
            .select(F.col("base").alias("parent"), F.col("asking").alias("child"))
            .unionByName(_enclosed(by_symbol, few_parents, thread, -1, chunk_rows)
                         .select(F.col("asking").alias("parent"), F.col("base").alias("child"))))
    return pairs.join(hits.withColumn("hit", F.lit(True)), ["parent", "child"], "left").select(
        "parent", "child", F.coalesce("hit", F.lit(False)).alias("overlaps"))


# ---- chains --------------------------------------------------------------------------------

def frame_parents(by_symbol: DataFrame, pairs: DataFrame, same_thread: bool = False, chunk_rows: int = scans.CHUNK_ROWS,
                  fan: int = scans.FAN) -> DataFrame:
    """(parent, child, frameId, parentId): for each (parent, child) symbol pair, the parent of every frame of the child symbol.

    The parent is the deepest shallower frame of the parent symbol that encloses the frame, earliest start first. Per
    parent symbol, time is cut into chunks of bounded rows; each is swept in start order by one Arrow group
    (`frame_sweep`), and what is open at its begin comes from a two-level scan over the chunks.
    """
    owner = ["parent", *(["tid"] if same_thread else [])]
    fields = ["tid", "kind", "depth", "startTime", "startTrace", "endTime", "endTrace", "frameId"]
    frames = by_symbol.select("symbol", *[F.col(c).cast("long").alias(c) for c in fields])
    pairs = pairs.select("parent", "child").distinct()
    own = (frames.withColumnRenamed("symbol", "parent").join(pairs.select("parent").distinct(), "parent", "left_semi")
           .select("parent", F.lit(None).cast("string").alias("child"), *fields))
    asked = frames.withColumnRenamed("symbol", "child").join(pairs, "child").select("parent", "child", *fields)
    cut = scans.time_chunks(own.unionByName(asked), owner, "startTime", chunk_rows)
    on = [*owner, "chunk"]
    head = "parent string, " + ("tid long, " if same_thread else "")

    def left_open(table: pa.Table, borders: list[int]) -> pa.Table:
        frames, own = sweep.frame_rows(table), table.column("child").is_null().to_numpy().tolist()
        opened = [sweep.left_open_of(frames[a:b], own[a:b]) for a, b in zip(borders, borders[1:])]
        heads = table.select(on).take(pa.array(borders[:-1], pa.int64()))
        return heads.append_column("open", pa.array(opened, pa.list_(pa.int64())))

    def parents(table: pa.Table, borders: list[int]) -> pa.Table:
        frames, asking = sweep.frame_rows(table), table.column("child").is_valid().to_numpy().tolist()
        entries, rows, found = table.column("entry"), [], []
        opens = entries.is_valid().to_numpy().tolist()
        for a, b in zip(borders, borders[1:]):
            first = a + opens[a]  # what is open before the chunk comes ahead of its frames
            at, ids = sweep.parents_of(frames[first:b], asking[first:b], entries[a].as_py() if opens[a] else [])
            rows += [first + i for i in at]
            found += ids
        return table.select(["parent", "child", "frameId"]).take(pa.array(rows, pa.int64())).append_column("parentId", pa.array(found, pa.int64()))

    local = scans.map_groups(cut.filter("chunks > 1").drop("chunks"), on, [], left_open, f"{head}chunk long, open array<long>")
    entries = scans.entry_states(local, owner, "open", sweep.join_open, fan)
    opened = entries.select(*on, F.coalesce("entry", F.array().cast("array<long>")).alias("entry"), F.lit(None).cast("string").alias("child"),
                            *[F.lit(0).cast("long").alias(c) for c in fields if c not in on])
    rows = cut.drop("chunks").withColumn("entry", F.lit(None).cast("array<long>"))
    return scans.map_groups(rows.unionByName(opened), on, [F.col("entry").isNull(), "startTime"], parents,
                            "parent string, child string, frameId long, parentId long")


def _whole_walks(stacks: DataFrame, parents: DataFrame) -> DataFrame:
    """(stack, frameId, chain): for each stack (symbols, leaf first) the frames whose walk up reaches the root, and their ancestors.

    Pointer doubling: round k knows the walks along pieces of 2^k steps (shorter at the root) that begin at every 2^k-th
    symbol, and joins neighbouring pieces. A piece that many stacks share is walked once. One job per round.
    """
    walks = durable(parents.select(F.array("child", "parent").alias("piece"), "frameId", F.array("parentId").alias("chain")))
    steps = 1
    while not stacks.filter(F.size("stack") - 1 > steps).isEmpty():
        size = F.size("stack")
        begins = F.sequence(F.lit(0), size - 2, F.lit(2 * steps))
        wanted = stacks.select(F.explode(F.transform(begins, lambda b: F.slice("stack", b + 1, 2 * steps + 1))).alias("piece")).distinct()
        short = wanted.filter(F.size("piece") <= steps + 1).join(walks, "piece")
        lower = (wanted.filter(F.size("piece") > steps + 1)
                 .select(F.col("piece").alias("whole"), F.slice("piece", 1, steps + 1).alias("piece"),
                         F.slice("piece", steps + 1, steps + 1).alias("rest")).join(walks, "piece"))
        upper = walks.select(F.col("piece").alias("rest"), F.col("frameId").alias("via"), F.col("chain").alias("more"))
        joined = lower.withColumn("via", F.element_at("chain", -1)).join(upper, ["rest", "via"]).select(
            F.col("whole").alias("piece"), "frameId", F.concat("chain", "more").alias("chain"))
        walks, steps = durable(short.select("piece", "frameId", "chain").unionByName(joined)), 2 * steps
    return stacks.select(F.col("stack").alias("piece")).join(walks, "piece").withColumnRenamed("piece", "stack")


def sampled_stack_match(samples: DataFrame, by_symbol: DataFrame, tolerance: int = TOLERANCE_NS,
                        same_thread: bool = False, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """The reconstructed frame for each symbol of each sampled stack (`symbols`, root first).

    From each frame of the leaf symbol that holds the sample's time, walk up: the next frame is the deepest enclosing
    shallower one, earliest start first. (It holds the time too, since it encloses one that does.) The first leaf (by
    start) whose walk is complete wins; otherwise each symbol is matched on its own.

    A frame's parent does not depend on the sample, so parents are found once per frame and symbol pair, and complete
    walks once per leaf frame and distinct stack. Samples only look for the first complete leaf that holds their time,
    and never meet frames in pairs.
    """
    positions = samples.select("sampleId", "time", F.posexplode("symbols").alias("position", "symbol"))
    keys = ["stack", *(["tid"] if same_thread else [])]
    stacked = samples.filter(F.size("symbols") > 1).withColumn("stack", F.reverse("symbols"))
    stacks = durable(stacked.select("stack").distinct())
    walks = _whole_walks(stacks, frame_parents(by_symbol, call_pairs(samples), same_thread, chunk_rows))
    leaves = _padded(by_symbol, tolerance).withColumn("leafOrder", F.struct("startTime", "startTrace", file_order().alias("file")))
    complete = (walks.withColumn("symbol", F.get("stack", 0)).join(leaves, ["symbol", "frameId"])
                .select(*keys, "lo", "hi", F.struct("leafOrder", F.concat(F.reverse("chain"), F.array("frameId")).alias("chain")).alias("best")))
    won = _first_holding(stacked, complete, keys, GRAIN_BITS).select("sampleId", "best.chain")
    alone = sample_frame_containment(positions.select("sampleId", "symbol", "time").distinct(), by_symbol,
                                     tolerance).select("sampleId", "symbol", F.col("frameId").alias("aloneId"))
    return positions.join(alone, ["sampleId", "symbol"], "left").join(won, "sampleId", "left").select(
        "sampleId", "position", "symbol",
        F.when(F.col("chain").isNotNull(), F.get("chain", F.col("position"))).otherwise(F.col("aloneId"))
        .alias("frameId"),
        F.col("chain").isNotNull().alias("chained"))


# ---- reports -------------------------------------------------------------------------------

def folded_stack_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(F.array_join("symbols", " -> ").alias("stack")).agg(F.count(F.lit(1)).alias("samples"))


def top_sampled_stacks(samples: DataFrame) -> DataFrame:
    return folded_stack_counts(samples).orderBy(F.desc("samples"), "stack")


def call_pairs(samples: DataFrame) -> DataFrame:
    """Distinct adjacent (parent, child) symbols."""
    size = F.size("symbols")
    zipped = F.arrays_zip(F.slice("symbols", 1, F.greatest(size - 1, F.lit(0))).alias("parent"),
                          F.slice("symbols", 2, F.greatest(size - 1, F.lit(0))).alias("child"))
    return (samples.select(F.explode(zipped).alias("p")).select("p.parent", "p.child").distinct())


def sampled_stack_report(samples: DataFrame, frames: DataFrame, locations: DataFrame,
                         tolerance: int = TOLERANCE_NS) -> dict[str, DataFrame]:
    """Three tables: unique stacks with the first sample's match, frames per symbol, all samples."""
    wanted = samples.select(F.explode("symbols").alias("symbol")).distinct()
    by_symbol = durable(frames_by_symbol(frames, locations, wanted))
    matched = durable(sampled_stack_match(samples, by_symbol, tolerance))
    chains = matched.groupBy("sampleId").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "frameId"))), lambda p: p["frameId"])
        .alias("frameIds"))
    shown = samples.join(chains, "sampleId", "left").select(
        "sampleId", "time", "ip", F.array_join("symbols", " -> ").alias("stack"), "frameIds")
    unique = shown.groupBy("stack").agg(F.count(F.lit(1)).alias("samples"),
                                        F.min_by("frameIds", "sampleId").alias("frameIds"))
    return {"unique": unique, "frames": symbol_frame_stats(by_symbol, wanted), "samples": shown}
