"""Substring dedup by seed and extend: winnowed anchors are joined, matches are extended both ways, repeats removed.

A repeat is a run of `length` words that also starts in a document with a smaller doc_id. Every such run holds a
winnowed anchor (the smallest hash of `length - seed + 1` neighbouring seeds of `seed` words), so only anchors that
several documents hold can lie in a repeat. Each anchor carries a hash of its extension: all words that a run
through it can reach to the left and right. Occurrences are settled at once where an earlier document has the same
extension; there the whole extension is a repeat. Where extensions differ, the first occurrence of each extension
is extended word by word: the runs through it are compared by content with those of the other extensions. No pairs
of documents are formed: every comparison is a grouped minimum of doc_id, combined before the shuffle, so passages
and copies in any number of documents cost one row per occurrence.

Null texts have no words; texts shorter than `length` have no run and stay whole. Rows with one doc_id are never
repeats of each other; rows with null doc_id neither remove nor are removed. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackweave.llm import words as W
from stackweave.llm.common import pieces, row_hash, stored

_SEEDS = pa.list_(pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("pos", pa.int32())]))


def _winnow(seeds: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost smallest of every `window` neighbouring seeds."""
    if len(seeds) <= window:
        return np.array([len(seeds) - 1 - np.argmin(seeds[::-1])]) if len(seeds) == window else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


def _text_sha(words: W.Words, chosen: np.ndarray) -> str:
    """SHA-256 of the chosen words joined by one space."""
    if not len(chosen):
        return hashlib.sha256(b"").hexdigest()
    starts, ends, data = words.starts[chosen], words.ends[chosen], words.data
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(at[-1]) - 1, 32, np.uint8)
    source = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[source + np.repeat(at[:-1], size)] = data[source + np.repeat(starts, size)]
    return hashlib.sha256(out.tobytes()).hexdigest()


def anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, row, n_words, sha, seeds): one row per document row, with its winnowed anchors and their extensions."""
    reach = length - seed

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            words = W.split(texts, W.SPACES)
            counts = np.diff(words.first)
            every = np.arange(len(words.starts))
            kept, contexts, lists, shas = [], [], [0], []
            at, hashes = words.windows(seed)
            firsts = np.searchsorted(at, words.first)
            for row, n in enumerate(counts.tolist()):
                a, b = int(words.first[row]), int(words.first[row + 1])
                shas.append(_text_sha(words, every[a:b]))
                if n >= length:
                    low = firsts[row]
                    kept.append(_winnow(hashes[low:low + n - seed + 1], reach + 1) + low)
                lists.append(lists[-1] + (len(kept[-1]) if n >= length else 0))
            chosen = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            place = at[chosen]
            begin = np.repeat(words.first[:-1], np.diff(lists))
            end = np.repeat(words.first[1:], np.diff(lists))
            left, right = np.maximum(place - reach, begin), np.minimum(place + length, end)
            if len(place):
                contexts = W.mix(words.ranges(left, right) + (place - left).astype(W.U) * W.U(0xE7037ED1A0B428DB))
            seeds = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(hashes[chosen].view(np.int64)), pa.array(np.asarray(contexts, W.U).view(np.int64)), pa.array((place - begin).astype(np.int32))],
                ["anchor", "context", "pos"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(shas), seeds],
                                             ["doc_id", "row", "n_words", "sha", "seeds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_hash(F.col("text")).alias("row")).mapInArrow(
        find, f"doc_id {kind}, row long, n_words long, sha string, seeds array<struct<anchor:long,context:long,pos:int>>")


def _extend(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Runs through the anchors at `places` of each document: (run, doc_id, row, pos)."""
    reach = length - seed

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            words = W.split(texts, W.SPACES)
            rows, starts = [], []
            for row, places in enumerate(batch.column("places").to_pylist()):
                base, n = int(words.first[row]), int(words.first[row + 1] - words.first[row])
                wanted = np.zeros(max(n - length + 1, 0), bool)
                for p in places:
                    wanted[max(p - reach, 0):p + 1] = True
                found = np.flatnonzero(wanted)
                rows.append(np.full(len(found), row))
                starts.append(found + base)
            rows, starts = np.concatenate(rows), np.concatenate(starts)
            picked = batch.select(["doc_id", "row"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.ranges(starts, starts + length).view(np.int64)), picked.column("doc_id"), picked.column("row"),
                 pa.array((starts - words.first[rows]).astype(np.int32))], ["run", "doc_id", "row", "pos"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(runs, f"run long, doc_id {kind}, row long, pos int")


def repeated_spans(docs: DataFrame, length: int = 50, seed: int = 16) -> tuple[DataFrame, DataFrame]:
    """The anchor table of all rows, and the affected documents: doc_id, row, text, spans (first word, end; may overlap)."""
    table = stored(anchors(docs, length, seed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = table.filter(F.col("doc_id").isNotNull()).select("doc_id", "row", F.inline("seeds"))
    shared = seen.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("context") != F.max("context")).alias("varied")).filter("low < high")
    found = stored(seen.join(shared.select("anchor", "varied"), "anchor"))
    first = found.groupBy("anchor", "context").agg(F.min("doc_id").alias("first"))
    judged = found.join(first, ["anchor", "context"])
    reach = length - seed
    # Settled anchors bring their whole extension as a span; open ones are extended.
    anchored = judged.groupBy("doc_id", "row").agg(
        F.collect_set(F.when(F.col("doc_id") > F.col("first"), F.col("pos"))).alias("settled"),
        F.collect_set(F.when((F.col("doc_id") == F.col("first")) & F.col("varied"), F.col("pos"))).alias("places"))
    texts = docs.select("doc_id", "text", row_hash(F.col("text")).alias("row"))
    affected = stored(anchored.filter((F.size("settled") > 0) | (F.size("places") > 0)).join(texts, ["doc_id", "row"]))
    runs = _extend(affected.filter(F.size("places") > 0).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "text", "places"), length, seed)
    runs = stored(runs)
    again = runs.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("run", "low")
    starts = runs.join(again, "run").filter("doc_id > low").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("starts"))
    spans = F.concat(
        F.transform("settled", lambda p: F.struct(F.greatest(p - reach, F.lit(0)).alias("start"), (p + length).alias("stop"))),
        F.transform(F.coalesce("starts", F.array().cast("array<int>")), lambda p: F.struct(p.alias("start"), (p + length).alias("stop"))))
    return table, affected.join(starts, ["doc_id", "row"], "left").select("doc_id", "row", "text", spans.alias("spans")).filter(F.size("spans") > 0)


def _gone(words: W.Words, row: int, spans: list[dict]) -> np.ndarray:
    n = int(words.first[row + 1] - words.first[row])
    steps = np.zeros(n + 1, np.int64)
    for s in spans:
        steps[s["start"]] += 1
        steps[min(s["stop"], n)] -= 1
    return np.cumsum(steps[:n]) > 0


def repeat_report(docs: DataFrame, length: int = 50, seed: int = 16) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table, affected = repeated_spans(docs, length, seed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            words = W.split(texts, W.SPACES)
            removed, shas = [], []
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                gone = _gone(words, row, spans)
                removed.append(int(gone.sum()))
                shas.append(_text_sha(words, np.flatnonzero(~gone) + int(words.first[row])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                                             ["doc_id", "row", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = affected.dropDuplicates(["doc_id", "row"]).mapInArrow(digest, f"doc_id {kind}, row long, removed long, kept string")
    return table.select("doc_id", "row", "n_words", "sha").join(changed, ["doc_id", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = 50, seed: int = 16) -> DataFrame:
    """`docs` without repeated words: changed texts hold their kept words joined by one space; others stay as they are."""
    _, affected = repeated_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")), length, seed)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            words = W.split(texts, W.SPACES)
            out = []
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                chosen = np.flatnonzero(~_gone(words, row, spans)) + int(words.first[row])
                out.append(b" ".join(words.text(int(w)) for w in chosen).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(out, pa.string())], ["doc_id", "__row", "__kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = affected.dropDuplicates(["doc_id", "row"]).mapInArrow(keep, f"doc_id {kind}, __row long, __kept string")
    joined = docs.withColumn("__row", row_hash(F.col("text").cast("string"))).join(kept, ["doc_id", "__row"], "left")
    changed = F.col("__kept").isNotNull()
    out = joined.withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op10_substring_dedup(spark, folder):
    from stackweave.llm.common import read
    return repeat_report(read(spark, folder, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM (SELECT *, row_number() OVER () AS r FROM documents)),
runs AS (SELECT r, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS run FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
again AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY run) AS low FROM runs) WHERE doc_id > low),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS word FROM again),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(one, ' ' ORDER BY i) AS body FROM (SELECT w.r, i, words[i] AS one FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE r IN (SELECT r FROM counts)) w
         ANTI JOIN gone ON gone.r = w.r AND gone.word = w.i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(body, '') END) AS kept_sha256
FROM w LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""
