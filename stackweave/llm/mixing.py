"""Mixing sources to target weights: blocks of words, multinomial shard draws, index permutations, a join by block.

Each source's documents stand one after another (in a fixed hashed order) and are cut into blocks of `block` words. The
output is a row of shards of `shard` slots. A slot is filled by one block of some source. How many slots of a shard
each source gets is a multinomial draw, conditioned on the sources' totals so that every source comes out at its
target: the shards form a binary tree, and at each node the slots of the left half are drawn without replacement from
those of the node, with a seed of the node's own. A shard finds its counts and its first slot per source by walking
from the root, so no shard waits for another and reruns agree. Slot k of a source takes block perm(k mod B) of its B
blocks, a keyed Feistel permutation of the index: each pass over a source takes every block once. The last slot of a
source takes only the words of its block that are still due, so a source is taken to its target, rounded to a word.

Targets: sources ordered by code point (null last) weigh 5, 2, 1, repeating; the sum of all sizes is shared by weight;
a source stops at `repeat` times its size and the excess is shared again. No document is taken more often than that.

Counts of 500,000,000 and more at a tree node, beyond numpy's exact sampler, are drawn from the normal limit of the same
hypergeometric law, whose relative error there is below 1e-4 of a standard deviation. Slots and blocks are both shuffled
by (source number, block); neither is broadcast, whatever Spark takes their size for.

Size is the number of words; null and empty texts have size 0 and are never taken. Rows are told apart by id, source
and text hash; equal rows are numbered as copies, each with a place of its own in the stream. Sources with no words have target 0. An empty table gives no rows.
Sources are collected to the driver with one number each; more than `max_sources` raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stackweave.llm import words as W
from stackweave.llm.common import local_table, pieces, row_hash, stored

WEIGHTS = (5.0, 2.0, 1.0)
_LARGE = 500_000_000  # counts from which the normal limit is drawn
ROWS_PER_CHUNK = 4096


def targets(sizes: np.ndarray, weights: np.ndarray, repeat: float) -> np.ndarray:
    """Share of the total by weight, no source above `repeat` times its size, excess shared again."""
    total, capped = float(sizes.sum()), np.zeros(len(sizes), bool)
    out = np.zeros(len(sizes))
    while True:
        rest = total - repeat * sizes[capped].sum()
        free = weights[~capped].sum()
        out = np.where(capped, repeat * sizes, weights * (rest / free if free else 0.0))
        over = ~capped & (out > repeat * sizes)
        if not over.any():
            return out
        capped |= over


def permute(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 .. count-1 for each index: a Feistel network on the least even number of bits, walked
    until the value is in range."""
    return _feistel(index, count, key, False)


def unpermute(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The inverse of `permute`: the place at which each value stands."""
    return _feistel(index, count, key, True)


def _feistel(index: np.ndarray, count: np.ndarray, key: np.ndarray, inverse: bool) -> np.ndarray:
    half = (np.ceil(np.log2(np.maximum(count, 2))).astype(np.uint64) + W.U(1)) // W.U(2)
    mask = (W.U(1) << half) - W.U(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for step in range(3, -1, -1) if inverse else range(4):
            if inverse:
                left, right = right ^ (W.mix(left + W.U(step << 56) + k) & m), left
            else:
                left, right = right, left ^ (W.mix(right + W.U(step << 56) + k) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= count[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw(random: np.random.Generator, held: np.ndarray, wanted: int) -> np.ndarray:
    """`wanted` of held.sum() without replacement, by source."""
    if held.sum() < _LARGE:
        return random.multivariate_hypergeometric(held, wanted, method="marginals")
    out, rest = np.zeros_like(held), int(held.sum())
    for i, mine in enumerate(map(int, held)):
        others = rest - mine
        low, high = max(0, wanted - others), min(mine, wanted)
        if low < high:
            share = mine / rest
            spread = np.sqrt(wanted * share * (others / rest) * ((rest - wanted) / max(1, rest - 1)))
            out[i] = min(high, max(low, round(wanted * share + spread * random.standard_normal())))
        else:
            out[i] = low
        wanted, rest = wanted - int(out[i]), others
    return out


def shard_counts(shard: int, shards: int, slots: int, totals: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in one shard, slots of each source in all shards before it)."""
    low, high, held, before = 0, shards, totals.copy(), np.zeros_like(totals)
    while high - low > 1:
        middle = (low + high) // 2
        wanted = min((middle - low) * slots, int(held.sum()))
        left = draw(np.random.Generator(np.random.PCG64([seed, low, high])), held, wanted)
        if shard < middle:
            held, high = left, middle
        else:
            before, held, low = before + left, held - left, middle
    return held, before


def word_counts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, source, text) without text, with row (text hash) and size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            data, offsets = W.buffers(texts)
            inside = ~W.SPACES[data]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            edge = offsets[1:-1][offsets[1:-1] < len(data)]
            opens[edge] = inside[edge]
            total = np.concatenate(([0], np.cumsum(opens)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "row")), pa.array(np.diff(total[offsets]), pa.int64())], ["doc_id", "source", "row", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", row_hash(F.col("text")).alias("row"), "text").mapInArrow(count, f"doc_id {kind}, source string, row long, size long")


def source_table(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: int = 3, max_sources: int = 100_000) -> pd.DataFrame:
    """source, size and target of every source, in order; blocks are not yet known."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.asc_nulls_last("source")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = np.array([r["size"] for r in rows], np.int64)
    weight = np.array([weights[i % len(weights)] for i in range(len(rows))])
    return pd.DataFrame({"source": [r["source"] for r in rows], "size": sizes, "target": targets(sizes.astype(float), weight, repeat) if len(rows) else sizes.astype(float)})


def numbered_copies(sized: DataFrame) -> DataFrame:
    """The rows of `sized` with copy: equal rows are counted 0, 1, ..."""
    return sized.groupBy("doc_id", "source", "row", "size").agg(F.count(F.lit(1)).alias("n")).select(
        "doc_id", "source", "row", "size", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))


def placed(sized: DataFrame) -> DataFrame:
    """(doc_id, source, row, copy, size, start): where the words of each document row start in its source's stream."""
    docs = numbered_copies(sized.filter("size > 0"))
    chunks = F.lit(max(1, -(-sized.count() // ROWS_PER_CHUNK)))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row", "copy"), chunks))
    totals = docs.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = F.sum("chunk_size").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("doc_id", "row", "copy").rowsBetween(Window.unboundedPreceding, -1))
    return docs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select(
        "doc_id", "source", "row", "copy", "size", (F.col("before") + F.col("inside")).alias("start"))


def filled_slots(spark, sources: pd.DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """(shard, slot, number, turn, block, take): the block of source `number` that fills each slot of the output, and how
    many of its words are taken, from its first."""
    sizes, wanted = sources["size"].to_numpy(np.int64), sources["target"].to_numpy()
    blocks = -(-sizes // block)
    full = np.where(sizes > 0, np.floor(wanted / np.maximum(sizes, 1) + 1e-9), 0).astype(np.int64)
    rest = np.clip(np.rint(wanted).astype(np.int64) - full * sizes, 0, sizes)
    lacks = blocks * block - sizes  # words by which a source's last block is short

    def keys(number: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return W.mix(number.astype(np.uint64) * W.U(0x9E3779B97F4A7C15) + turn.astype(np.uint64) + W.U(seed << 32))

    short = np.zeros(len(sizes), np.int64)  # where the short block stands in the last pass
    some = np.flatnonzero(sizes > 0)
    short[some] = unpermute(blocks[some] - 1, blocks[some], keys(some, full[some]))
    last = -(-rest // block)
    last += last * block - lacks * (short < last) < rest
    totals = full * blocks + last
    shards = max(1, int(-(-totals.sum() // shard)))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["id"]:
                held, before = shard_counts(int(s), shards, shard, totals, seed)
                number = np.repeat(np.arange(len(held)), held)
                k = np.arange(len(number)) - np.repeat(np.cumsum(held) - held, held) + before[number]
                count = blocks[number]
                turn = k // count
                due = rest[number] - (k % count * block - lacks[number] * (short[number] < k % count))
                yield pd.DataFrame({"shard": s, "slot": np.random.Generator(np.random.PCG64([seed, 1, int(s)])).permutation(len(number)), "number": number.astype(np.int32),
                                    "turn": turn.astype(np.int32), "block": permute(k % count, count, keys(number, turn)),
                                    "take": np.where(turn < full[number], block, np.minimum(due, block))})

    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, tasks).mapInPandas(fill, "shard long, slot long, number int, turn int, block long, take long")


def mix(docs: DataFrame, block: int = 128, shard: int = 1024, seed: int = 20240229, weights: tuple[float, ...] = WEIGHTS, repeat: int = 3) -> tuple[DataFrame, pd.DataFrame, DataFrame]:
    """(sized documents, sources, pieces): pieces says which words of which document stand where in the output.

    pieces: shard, slot, turn, doc_id, source, row, copy, first_word, last_word (exclusive).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = stored(word_counts(docs))
    sources = source_table(sized, weights, repeat)
    numbered = local_table(spark, {"s": (pa.string(), sources["source"].tolist()), "number": (pa.int32(), range(len(sources)))})
    streams = placed(sized).join(numbered, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    spread = streams.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))).withColumns({
        "first_word": F.greatest(F.col("block") * block - F.col("start"), F.lit(0)), "last_word": F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))})
    slots = filled_slots(spark, sources, block, shard, seed)
    taken = slots.hint("merge").join(spread.drop("size"), ["number", "block"]).withColumn("last_word", F.least("last_word", F.col("block") * block + F.col("take") - F.col("start")))
    return sized, sources, taken.filter("last_word > first_word").drop("number", "block", "take", "start")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document row."""
    sized, sources, found = mix(docs, **options)
    spark = docs.sparkSession
    taken = found.groupBy("doc_id", "source", "row", "copy").agg(F.sum(F.col("last_word") - F.col("first_word")).alias("taken")).withColumnsRenamed(
        {"doc_id": "d", "source": "s", "row": "r", "copy": "c"})
    table = local_table(spark, {"t": (pa.string(), sources["source"].tolist()), "source_size": (pa.int64(), sources["size"]), "target": (pa.float64(), sources["target"])})
    joined = numbered_copies(sized).join(table, F.col("source").eqNullSafe(F.col("t")))
    joined = joined.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("row") == F.col("r")) & (F.col("copy") == F.col("c")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The words that the mix takes, as rows with the columns of `docs`: one row per document row and pass over its source.

    A document that a pass takes whole keeps its text as it is; else the text is its taken words joined by one space.
    Of rows equal in id, source and text, which differ in other columns, one lends these to all. n_chars, where present, is counted anew for cut texts.
    """
    _, _, found = mix(docs, **options)
    turns = found.groupBy("doc_id", "source", "row", "copy", "turn").agg(F.array_sort(F.collect_list(F.struct("first_word", "last_word"))).alias("__runs")).withColumnsRenamed(
        {"doc_id": "__d", "source": "__s", "row": "__r", "turn": "__turn", "copy": "__copy"})
    marked = docs.withColumn("__row", row_hash(F.col("text").cast("string")))
    rows = marked.dropDuplicates(["doc_id", "source", "__row"])
    joined = rows.join(turns, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").cast("string").eqNullSafe(F.col("__s")) & (F.col("__row") == F.col("__r"))).drop("__d", "__s", "__r", "__row", "__turn", "__copy")
    where = joined.schema.names.index("text")
    chars = joined.schema.names.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            words, out = W.split(texts, W.SPACES), batch.column(where).to_pylist()
            lengths = batch.column(chars).to_pylist() if chars is not None else []
            for i, runs in enumerate(batch.column("__runs").to_pylist()):
                n, base = int(words.first[i + 1] - words.first[i]), int(words.first[i])
                if sum(r["last_word"] - r["first_word"] for r in runs) < n:
                    out[i] = b" ".join(words.text(base + w) for r in runs for w in range(r["first_word"], r["last_word"])).decode()
                    if chars is not None:
                        lengths[i] = len(out[i])
            columns = batch.columns
            columns[where] = pa.array(out, batch.schema.field(where).type)
            if chars is not None:
                columns[chars] = pa.array(lengths, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return joined.mapInArrow(cut, joined.schema).select(docs.columns)


def op5_mix_sources(spark, folder):
    from stackweave.llm.common import read
    return mix_report(read(spark, folder, "documents"))
