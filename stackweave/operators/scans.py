"""Ordered per-key computations that never put a whole key into one task.

A window over `partitionBy(key)` sends every row of a hot key to a single task. Here a key is
first split into consecutive chunks of bounded size; each chunk runs its own window, a one-row
summary per chunk is scanned over the key, and the carry is joined back. The row-level shuffle
is on (key, chunk), the scan over the key sees one row per chunk.

`chunk` must not decrease along `order` within a key. Dense positions give chunks by division
(`with_chunk`), times by splitters that are counted, not sampled (`time_chunks`), so every reader of a
plan sees the same chunks and nothing has to be written in between.

Carries over many chunks go two levels: runs of FAN chunks are combined side by side, and one row per
run is scanned, so that no task sees all chunks of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_ROWS = 1 << 16
_ID_SPAN = 1 << 16
# Chunks per combined run.
FAN = 1 << 10
# Times are counted in cells of 2^16 ns (65 us); 2^12 cells make a middle cell, 2^12 of these a top cell (18 min).
_CELL_BITS, _STEP_BITS = 16, 12
# Steps of the binary search for a row's chunk: keys of more than 2^24 chunks leave the rest to the last one.
_SEARCH_BITS = 24


def whole(dividend: Column, divisor: int) -> Column:
    """Integer division without a detour over doubles."""
    return F.call_function("div", dividend, F.lit(divisor).cast("long"))


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _carried(df: DataFrame, summary: DataFrame, on: list[str]) -> DataFrame:
    """Join one summary row per chunk to its rows (keys are not null).

    Plain equality on (keys, chunk): a shuffle for the join also serves the window that follows.
    """
    return df.join(summary, on, "left")


def with_chunk(df: DataFrame, position: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `chunk` from a dense integer position."""
    return df.withColumn("chunk", whole(F.col(position), chunk_rows))


def _starts(cells: Column, most: int, bits: int) -> Column:
    """Where chunks of at most `most` rows begin, from an array of cells (cell, rows, starts) of `bits` bits.

    Neighbouring cells are merged in order; a cell with too many rows brings the starts found inside it.
    """
    nothing = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(most).cast("long").alias("rows"))

    def step(done: Column, cell: Column) -> Column:
        crowded, fits = cell["rows"] > most, done["rows"] + cell["rows"] <= most
        own = F.coalesce(cell["starts"], F.array(F.shiftleft(cell["cell"], bits)))
        return F.struct(F.when(fits, done["starts"]).otherwise(F.concat(done["starts"], own)).alias("starts"),
                        F.when(crowded, F.lit(most).cast("long")).when(fits, done["rows"] + cell["rows"]).otherwise(cell["rows"]).alias("rows"))

    return F.aggregate(F.array_sort(cells), nothing, step)["starts"]


def time_splitters(df: DataFrame, keys: list[str], at: str, most: int = CHUNK_ROWS, cell_bits: int = _CELL_BITS) -> DataFrame:
    """(keys, starts): where the chunks of every key with more than `most` rows begin, ascending.

    Keys are counted first, so that cells are made for the long ones only. Their rows are counted per key and cell of 65 us,
    combined before the shuffle. Twice 2^12 cells are rolled up into one row
    of the cell above, with the starts found inside if it holds too many rows; on top, a key has one row per 18 minutes of
    the trace. A single cell may exceed `most`: more than 2^16 rows of one key within 65 us stay together.
    """
    def above(cell: str) -> Column:
        return F.shiftright(cell, _STEP_BITS).alias("upper")

    # At most one key in `most` rows is long, so a broadcast of them stays small.
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most).select(*keys)
    rows = df.join(F.broadcast(long), keys, "left_semi").groupBy(*keys, F.shiftright(at, cell_bits).alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    rows, bits = rows.withColumn("starts", F.lit(None).cast("array<bigint>")), cell_bits
    for level in range(3):
        last = level == 2
        cells = F.collect_list(F.struct("cell", "rows", "starts"))
        rolled = rows.groupBy(*keys, *([] if last else [above("cell")])).agg(F.sum("rows").alias("rows"), cells.alias("cells"))
        crowded = F.col("rows") > most
        rows = (rolled.filter(crowded) if last else rolled).select(
            *keys, *([] if last else [F.col("upper").alias("cell")]), "rows", F.when(crowded, _starts(F.col("cells"), most, bits)).alias("starts"))
        bits += _STEP_BITS
    # Every chunked plan reads this small table several times: kept where it is first computed, with its lineage, and the
    # same again if lost, since it is counted and not sampled.
    return rows.select(*keys, "starts").persist()


def time_chunks(df: DataFrame, keys: list[str], at: str, most: int = CHUNK_ROWS, splitters: DataFrame | None = None) -> DataFrame:
    """Add `chunk`, numbered along `at` within each key, with at most `most` rows each (see `time_splitters`), and `chunks`.

    A key with a third of all rows has its rows joined with one small row. The splitters are broadcast: they hold no more than two
    numbers for `most` rows of the table, and the rows need no shuffle for it.
    """
    splitters = time_splitters(df, keys, at, most) if splitters is None else splitters
    steps = F.array(*[F.lit(1 << b) for b in range(_SEARCH_BITS - 1, -1, -1)])
    # Number of starts at or before the row, bit by bit.
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step <= F.size("starts")) & (F.get("starts", low + step - 1) <= F.col(at)), low + step).otherwise(low))
    return (df.join(F.broadcast(splitters), keys, "left")
            .withColumn("chunk", F.when(F.col("starts").isNull(), 0).otherwise(found).cast("long"))
            .withColumn("chunks", F.when(F.col("starts").isNull(), 1).otherwise(F.size("starts") + 1)).drop("starts"))


def entry_states(local: DataFrame, keys: list[str], state: str, fold: Callable, fan: int = FAN) -> DataFrame:
    """(keys, chunk, entry): what all earlier chunks of the key leave behind, from one row (keys, chunk, `state`) per chunk.

    `fold(carried, state)` must be associative, with None before the first chunk. It runs on Arrow groups of at most `fan`
    chunks: runs are combined, one row per run is scanned, and runs then find their chunks' entries side by side.
    """
    fields = {f.name: f.dataType for f in local.schema.fields}
    head = ", ".join(f"{k} {fields[k].simpleString()}" for k in keys)
    kind = fields[state].simpleString()

    def states(table: pa.Table, carried) -> tuple[pa.Table, list, object]:
        table = table.sort_by("chunk")
        entries = []
        for value in table.column("state").to_pylist():
            entries.append(carried)
            carried = fold(carried, value)
        return table, entries, carried

    def total(table: pa.Table) -> pa.Table:
        ordered, _, last = states(table, None)
        return pa.table({**{k: ordered.column(k).slice(0, 1) for k in keys}, "chunk": ordered.column("run").slice(0, 1),
                         "state": pa.array([last], ordered.schema.field("state").type)})

    def entered(table: pa.Table, carried) -> pa.Table:
        ordered, entries, _ = states(table, carried)
        return pa.table({**{k: ordered.column(k) for k in keys}, "chunk": ordered.column("chunk"),
                         "entry": pa.array(entries, ordered.schema.field("state").type)})

    rows = local.select(*keys, "chunk", F.col(state).alias("state")).withColumn("run", whole(F.col("chunk"), fan))
    runs = rows.groupBy(*keys, "run").applyInArrow(total, f"{head}, chunk long, state {kind}")
    starts = (runs.groupBy(*keys).applyInArrow(lambda table: entered(table, None), f"{head}, chunk long, entry {kind}")
              .withColumnRenamed("chunk", "run"))
    on = [*keys, "run"]
    return rows.groupBy(*on).cogroup(starts.groupBy(*on)).applyInArrow(
        lambda table, start: entered(table, start.column("entry")[0].as_py() if start.num_rows else None), f"{head}, chunk long, entry {kind}")


def _borders(table: pa.Table, keys: Sequence[str]) -> list[int]:
    """Row numbers at which another group begins, without the first row, in a table sorted by `keys`."""
    changed = None
    for key in keys:
        column = table.column(key).combine_chunks()
        one, two = column.slice(0, len(column) - 1), column.slice(1)
        if pa.types.is_nested(column.type):  # which Arrow does not compare
            values = column.to_pylist()
            other = pa.array([a != b for a, b in zip(values, values[1:])], pa.bool_())
        else:
            other = pc.or_(pc.fill_null(pc.not_equal(one, two), False), pc.xor(one.is_null(), two.is_null()))
        changed = other if changed is None else pc.or_(changed, other)
    return [at + 1 for at in pc.indices_nonzero(changed).to_pylist()]


def map_groups(df: DataFrame, keys: list[str], order: Sequence[str | Column], function: Callable[[pa.Table, list[int]], pa.Table],
               schema: str) -> DataFrame:
    """What `groupBy(keys).applyInArrow` does, for many small groups: a group costs no Arrow stream of its own.

    Rows are dealt by `keys` into all shuffle partitions (Python time, not bytes, is what counts), sorted by keys and `order`, and
    come to `function` as a table of whole groups and their borders: group i is rows borders[i] to borders[i + 1]. No table holds
    more than one batch and one group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            borders = _borders(table, keys)
            if borders:
                yield from function(table.slice(0, borders[-1]).combine_chunks(), [0, *borders]).to_batches()
                table = table.slice(borders[-1])
            held = table
        if held is not None:
            yield from function(held.combine_chunks(), [0, held.num_rows]).to_batches()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys, *_order(order))
    return dealt.mapInArrow(run, schema)


def lists(table: pa.Table, names: Sequence[str]) -> list[list]:
    """Columns as Python lists, by way of numpy where no value is missing."""
    return [c.to_pylist() if c.null_count else c.to_numpy().tolist() for c in map(table.column, names)]


def _carry(summary: DataFrame, keys: list[str], value: str, join: Callable[[Column, Column], Column],
           all_of: Callable[[str], Column], before: Callable[[str], Column], fan: int) -> DataFrame:
    """(keys, chunk, __carry): `value` of all earlier chunks of the key.

    Chunks are packed into one row per run of `fan`; these rows are scanned per key, then unpacked and scanned inside each run.
    """
    def window(columns: list[str], order: str):
        return Window.partitionBy(*columns).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    chunk = F.col("chunk").cast("long")
    packed = summary.select(*keys, chunk.alias("chunk"), value, whole(chunk, fan).alias("__run")).groupBy(*keys, "__run").agg(
        F.collect_list(F.struct("chunk", value)).alias("__items"), all_of(value).alias("__all"))
    started = packed.withColumn("__start", before("__all").over(window(keys, "__run")))
    return (started.select(*keys, "__run", "__start", F.inline("__items"))
            .withColumn("__inside", before(value).over(window([*keys, "__run"], "chunk")))
            .select(*keys, "chunk", join(F.col("__start"), F.col("__inside")).alias("__carry")))


def carried_sum(summary: DataFrame, keys: list[str], value: str, out: str, fan: int = FAN) -> DataFrame:
    """Add `out`: the sum of `value` over all earlier chunks of the key, to a table of one row per chunk."""
    carry = _carry(summary, keys, value, _plus, F.sum, F.sum, fan).withColumnRenamed("__carry", out)
    return summary.join(carry, [*keys, "chunk"])


def carried_max(summary: DataFrame, keys: list[str], value: str, out: str, fan: int = FAN) -> DataFrame:
    """Add `out`: the greatest `value` of the key up to and including each chunk, to a table of one row per chunk."""
    carry = _carry(summary, keys, value, _later, F.max, F.max, fan)
    return summary.join(carry, [*keys, "chunk"]).withColumn(out, _later(F.col("__carry"), F.col(value))).drop("__carry")


def _plus(first: Column, second: Column) -> Column:
    return F.coalesce(first, F.lit(0)) + F.coalesce(second, F.lit(0))


def _later(first: Column, second: Column) -> Column:
    """The greater of two values that may be null."""
    return F.when(second.isNull(), first).when(first.isNull() | (second >= first), second).otherwise(first)


def split_running_sum(df: DataFrame, keys: list[str], order: Sequence[str | Column], value: str,
                      out: str) -> DataFrame:
    """Inclusive running sum of `value` per key."""
    on = [*keys, "chunk"]
    totals = df.groupBy(*on).agg(F.sum(value).alias("__total"))
    carry = _carry(totals, keys, "__total", _plus, F.sum, F.sum, FAN)
    within = Window.partitionBy(*on).orderBy(*_order(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (_carried(df, carry, on)
            .withColumn(out, F.sum(value).over(within) + F.col("__carry")).drop("__carry"))


def split_running_max(df: DataFrame, keys: list[str], order: Sequence[str | Column], value: str,
                      out: str, inclusive: bool = True) -> DataFrame:
    """Running maximum of `value` per key, over rows up to (or strictly before) each row."""
    on = [*keys, "chunk"]
    peaks = df.groupBy(*on).agg(F.max(value).alias("__peak"))
    carry = _carry(peaks, keys, "__peak", _later, F.max, F.max, FAN)
    within = Window.partitionBy(*on).orderBy(*_order(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = F.max(value).over(within)
    return (_carried(df, carry, on).withColumn("__local", local)
            .withColumn(out, _later(F.col("__carry"), F.col("__local")))
            .drop("__carry", "__local"))


def split_row_number(df: DataFrame, keys: list[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """1-based position of each row within its key."""
    on = [*keys, "chunk"]
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    carry = _carry(counts, keys, "__rows", _plus, F.sum, F.sum, FAN)
    within = Window.partitionBy(*on).orderBy(*_order(order))
    return (_carried(df, carry, on)
            .withColumn(out, (F.row_number().over(within) + F.col("__carry")).cast("long"))
            .drop("__carry"))


def split_lag(df: DataFrame, keys: list[str], order: Sequence[str | Column], values: list[str],
              out: str) -> DataFrame:
    """`out` = struct of `values` of the preceding row of the key, null on the first row."""
    on = [*keys, "chunk"]
    ordered = _order(order)
    sort_key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ordered)])
    payload = F.struct(*[F.col(v) for v in values])
    last = df.groupBy(*on).agg(F.max_by(payload, sort_key).alias("__last"))
    carry = last.select(*on, F.lag("__last").over(
        Window.partitionBy(*keys).orderBy("chunk")).alias("__carry"))
    within = Window.partitionBy(*on).orderBy(*ordered)
    return (_carried(df, carry, on)
            .withColumn(out, F.coalesce(F.lag(payload).over(within), F.col("__carry")))
            .drop("__carry"))


def split_last(df: DataFrame, keys: list[str], order: Sequence[str | Column], value: str,
               out: str) -> DataFrame:
    """Last non-null `value` up to and including each row of the key."""
    on = [*keys, "chunk"]
    ordered = _order(order)
    sort_key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ordered)])
    last = df.filter(F.col(value).isNotNull()).groupBy(*on).agg(
        F.max_by(value, sort_key).alias("__last"))
    present = df.select(*on).distinct()
    carry = _carry(_carried(present, last, on), keys, "__last", lambda a, b: F.coalesce(b, a),
                   lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct("chunk", v)))[v],
                   lambda v: F.last(v, ignorenulls=True), FAN)
    within = Window.partitionBy(*on).orderBy(*ordered).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (_carried(df, carry, on)
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("__carry")))
            .drop("__carry"))


def prefix_totals(counts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over all rows with a smaller integer `key` (one row per key).

    Keys are grouped in spans of 2^16, so for 32-bit keys neither the scan over spans nor the
    one inside a span exceeds 2^16 rows.
    """
    spans = counts.withColumn("__span", whole(F.col(key), _ID_SPAN))
    totals = spans.groupBy("__span").agg(F.sum(value).alias("__total"))
    before_span = Window.partitionBy(F.lit(0)).orderBy("__span").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = totals.select("__span", F.coalesce(F.sum("__total").over(before_span), F.lit(0)).alias("__spanBase"))
    before_key = Window.partitionBy("__span").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (spans.join(bases, "__span")
            .withColumn(out, (F.col("__spanBase") + F.coalesce(F.sum(value).over(before_key), F.lit(0))).cast("long"))
            .drop("__span", "__spanBase"))


def dense_numbers(df: DataFrame, position: str, order: Sequence[str | Column], out: str,
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """1-based number over the whole table, ordered by an integer position, then `order`.

    The position is cut in spans; one row per span is scanned, never the table itself.
    """
    cut = with_chunk(df, position, chunk_rows)
    counts = cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("__rows"))
    offsets = prefix_totals(counts, "chunk", "__rows", "__base").select("chunk", "__base")
    within = Window.partitionBy("chunk").orderBy(position, *_order(order))
    return (cut.join(offsets, "chunk")
            .withColumn(out, (F.row_number().over(within) + F.col("__base")).cast("long"))
            .drop("chunk", "__base"))


def ordered_numbers(df: DataFrame, key: str, at: str, order: Sequence[str | Column], out: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """1-based number over the whole table, ordered by an integer `key`, then `order`, which begins with the integer `at`.

    A key with a third of all rows is cut along `at`; the table itself is never sorted as a whole.
    """
    inside = split_row_number(time_chunks(df, [key], at, chunk_rows), [key], order, "__inside").drop("chunk", "chunks")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    bases = prefix_totals(sizes, key, "__rows", "__base").select(key, "__base")
    return inside.join(bases, key).withColumn(out, F.col("__base") + F.col("__inside")).drop("__base", "__inside")


def track_numbers(df: DataFrame, at: str, order: Sequence[str | Column], out: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`ordered_numbers` by tid and kind (0 or 1)."""
    track = df.withColumn("__track", (F.col("tid") * 2 + F.col("kind")).cast("long"))
    return ordered_numbers(track, "__track", at, order, out, chunk_rows).drop("__track")
