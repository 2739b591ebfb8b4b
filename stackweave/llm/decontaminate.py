"""Benchmark decontamination: a broadcast set of test n-grams, scanned over every window of every document.

Windows are `length` consecutive words after lower-casing A-Z; a benchmark item of fewer words, but not none,
is one window. The set of windows is broadcast only while it has at most `most_windows` entries. A larger benchmark
stays in Spark: a table of 2^28 bits (32 MB) tells tasks which document windows may be known, and these are joined
with the benchmark's by hash, size and words. A hash that occurs is verified on the words themselves either way.

Null texts have no words. Rows with a null id, repeated ids and repeated texts are judged row by row; an item
without id marks words but is not listed. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackweave.llm import words as W
from stackweave.llm.common import pieces, row_hash, stored

TABLE_BITS = 28
HITS = "array<struct<item:string,start:int,stop:int>>"
_HIT = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def benchmark_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(hash, size, words, item): the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            items = batch.column("item").to_pylist()
            words = W.split(texts, W.PUNCTUATION, lower=True)
            rows = []
            for i, item in enumerate(items):
                a, b = int(words.first[i]), int(words.first[i + 1])
                size = min(length, b - a)
                starts = np.arange(a, b - size + 1) if size else np.zeros(0, np.int64)
                for s, h in zip(starts.tolist(), words.ranges(starts, starts + size).view(np.int64).tolist()):
                    rows.append((h, size, b" ".join(words.text(w, True) for w in range(s, s + size)), item))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int32(), pa.binary(), pa.string()))], ["hash", "size", "words", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, "hash long, size int, words binary, item string").distinct()


class _Set:
    """A set of windows: per size, sorted hashes behind a bitmap, and the words to verify."""

    def __init__(self, table: pa.Table):
        self.words: dict[int, list[tuple[bytes, str | None]]] = {}
        sizes: dict[int, set[int]] = {}
        for row in table.to_pylist():
            self.words.setdefault(row["hash"], []).append((bytes(row["words"]), row["item"]))
            sizes.setdefault(row["size"], set()).add(row["hash"])
        self.sizes = {s: np.sort(np.array(list(h), np.int64).view(np.uint64)) for s, h in sizes.items()}
        self.maps = {}
        for size, hashes in self.sizes.items():
            self.maps[size] = np.zeros(1 << 20, bool)
            self.maps[size][hashes >> W.U(44)] = True

    def find(self, words: W.Words) -> list[tuple[int, int, str | None]]:
        """(first word, last word + 1, item) of every verified occurrence, in the numbering of `words`."""
        found = []
        for size, hashes in self.sizes.items():
            at, seen = words.windows(size)
            keep = np.flatnonzero(self.maps[size][seen >> W.U(44)])
            at, seen = at[keep], seen[keep]
            places = np.minimum(np.searchsorted(hashes, seen), len(hashes) - 1)
            exact = hashes[places] == seen
            for s, h in zip(at[exact].tolist(), seen[exact].view(np.int64).tolist()):
                text = b" ".join(words.text(w, True) for w in range(s, s + size))
                found += [(s, s + size, item) for known, item in self.words[h] if known == text]
        return found


def _scan(df: DataFrame, windows: pa.Table) -> DataFrame:
    """Append the hits of `windows` to column `__hits` and count words."""
    column, counted = df.schema.names.index("__hits"), df.schema.names.index("__words")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Set(windows)
        for batch, texts in pieces(batches, "__text"):
            words = W.split(texts, W.PUNCTUATION, lower=True)
            hits = batch.column(column).to_pylist()
            found = sorted(known.find(words), key=lambda x: x[:2])
            if found:
                rows = np.searchsorted(words.first, [x[0] for x in found], "right") - 1
                for row, (start, stop, item) in zip(rows.tolist(), found):
                    base = int(words.first[row])
                    hits[row] = hits[row] + [{"item": item, "start": start - base, "stop": stop - base}]
            columns = batch.columns
            columns[column] = pa.array(hits, _HIT)
            columns[counted] = pa.array(np.diff(words.first), pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(scan, df.schema)


def _known(windows: DataFrame) -> np.ndarray:
    """2^28 bits, packed: those at the leading bits of the windows' hashes are set. The driver reads 2^10 rows of 32 KB at most each."""
    place = F.shiftrightunsigned("hash", 64 - TABLE_BITS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column("places"):
                bits = np.zeros(1 << 18, bool)
                bits[places.values.to_numpy() & ((1 << 18) - 1)] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["chunk", "bits"])

    chunks = windows.select(place.alias("place")).groupBy(F.shiftright("place", 18).alias("chunk")).agg(F.collect_set("place").alias("places"))
    table = np.zeros((1 << TABLE_BITS - 18, 1 << 15), np.uint8)
    for row in chunks.mapInArrow(pack, "chunk long, bits binary").toLocalIterator():
        table[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def _join(df: DataFrame, windows: DataFrame) -> DataFrame:
    """As `_scan`, for any number of windows. Hits depend on the text alone, so rows of equal id and text share them."""
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most `length`
    table = df.sparkSession.sparkContext.broadcast(_known(windows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "__text"):
            words = W.split(texts, W.PUNCTUATION, lower=True)
            for size in sizes:
                at, seen = words.windows(size)
                place = seen >> W.U(64 - TABLE_BITS)
                keep = np.flatnonzero((table.value[place >> W.U(3)] >> (place & W.U(7)).astype(np.uint8)) & 1)
                for low in range(0, len(keep), 1 << 14):
                    here = keep[low:low + (1 << 14)]
                    starts = at[here]
                    rows = np.searchsorted(words.first, starts, "right") - 1
                    body = [b" ".join(words.text(w, True) for w in range(s, s + size)) for s in starts.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), batch.column("__row").take(pa.array(rows)), pa.array(seen[here].view(np.int64)), pa.array(np.full(len(here), size, np.int32)),
                         pa.array((starts - words.first[rows]).astype(np.int32)), pa.array(body, pa.binary())], ["doc_id", "__row", "hash", "size", "start", "words"])

    df = df.withColumn("__row", row_hash(F.col("__text")))
    kind = df.schema["doc_id"].dataType.simpleString()
    found = df.select("doc_id", "__row", "__text").mapInArrow(cut, f"doc_id {kind}, __row long, hash long, size int, start int, words binary")
    hits = stored(found.join(windows, ["hash", "size", "words"]).groupBy(F.col("doc_id").alias("__id"), F.col("__row").alias("__of")).agg(
        F.collect_set(F.struct("item", "start", (F.col("start") + F.col("size")).alias("stop"))).cast(HITS).alias("__found")))
    table.unpersist()
    counted = _scan(df, windows.limit(0).toArrow())
    joined = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__of")), "left")
    return joined.withColumn("__hits", F.coalesce("__found", "__hits")).drop("__id", "__of", "__found", "__row")


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, most_windows: int = 200_000) -> DataFrame:
    """`docs` with `__words` (count) and `__hits`: item, first word and end of every occurrence of a window."""
    windows = stored(benchmark_windows(benchmark, length))
    df = docs.withColumns({"__text": F.col("text").cast("string"), "__words": F.lit(0).cast("long"), "__hits": F.array().cast(HITS)})
    if windows.count() <= most_windows:
        return _scan(df, windows.toArrow()).drop("__text")
    return _join(df, windows).drop("__text")


def _measures(hits: list[dict]) -> tuple[int, int, str]:
    hit, end = 0, 0
    for start, stop in sorted((h["start"], h["stop"]) for h in hits):
        hit += max(0, stop - max(start, end))
        end = max(end, stop)
    items = sorted({h["item"] for h in hits if h["item"] is not None})
    return hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination_report(docs: DataFrame, benchmark: DataFrame, length: int = 10, most_windows: int = 200_000) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_measures(h) for h in batch.column("__hits").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__words"), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))),
                 pa.array([f[0] > 0 for f in found], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    found = find_contamination(docs.select("doc_id", "text"), benchmark, length, most_windows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "__words", "__hits").mapInArrow(
        digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, spans: bool = False, most_windows: int = 200_000) -> DataFrame:
    """`docs` without contaminated documents, or with `spans=True` without the words that were hit.

    With `spans`, bytes from the first to the last word of each run of hit words go; n_chars, where present,
    is counted anew. Untouched texts stay byte for byte, null texts stay null.
    """
    found = find_contamination(docs, benchmark, length, most_windows)
    if not spans:
        return found.filter(F.size("__hits") == 0).drop("__hits", "__words")
    where = found.schema.names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            words, out = W.split(texts, W.PUNCTUATION, lower=True), batch.column(where).to_pylist()
            for row, hits in enumerate(batch.column("__hits").to_pylist()):
                if not hits:
                    continue
                body, base, begin = words.data[words.offsets[row]:words.offsets[row + 1]].tobytes(), int(words.first[row]), int(words.offsets[row])
                runs: list[list[int]] = []
                for start, stop in sorted((h["start"], h["stop"]) for h in hits):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], stop)
                    else:
                        runs.append([start, stop])
                kept, at = [], 0
                for start, stop in runs:
                    kept.append(body[at:int(words.starts[base + start]) - begin])
                    at = int(words.ends[base + stop - 1]) - begin
                out[row] = b"".join([*kept, body[at:]]).decode()
            columns = batch.columns
            columns[where] = pa.array(out, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    cleaned = found.mapInArrow(cut, found.schema)
    touched = F.size("__hits") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(touched, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.drop("__hits", "__words")


def op9_benchmark_decontamination(spark, folder):
    from stackweave.llm.common import read
    return contamination_report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


SQL = r"""
WITH w AS (SELECT doc_id, rowid AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
           FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS body
       FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, array_to_string(words[i:i + size - 1], ' ') AS body
       FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size)),
hits AS (SELECT r, item, i, dw.size FROM dw JOIN bw ON dw.body = bw.body AND dw.size = bw.size),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + size)) AS word FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
