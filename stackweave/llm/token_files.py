"""Token-ID output: ids of whole texts in files of independent blocks, coded with range asymmetric numerals (rANS).

Format. A table of frequencies (`symbol`, `freq`, summing to 2^20) is shared by all files. A file is a range of doc_id;
its blocks are rows of a Parquet table, the container that Spark can write to any store: `file`, `block`, `start`
(ids of all documents before it), `n_ids`, `docs` and `lengths` (documents with ids in the block and how many),
`skipped` (ids of the first document in earlier blocks), `open` (the last document goes on in the next block),
`states` (one 64-bit coder state per lane), `payload` (32-bit words), `checkpoints` and `crc` (CRC-32 of the ids).
Ids are dealt to `LANES` interleaved lanes, so all lanes are coded at once. Every `CHECK` ids there is a checkpoint:
the payload position and all lane states, from which decoding can start. Blocks need only the shared table: any block,
and any stretch between checkpoints, can be decoded by itself.

Steps: texts are dealt to ranges of ids and sorted, each range is encoded to raw blocks in one streamed task, symbols
are counted over all blocks, blocks are coded, written, read back, decoded and checked. Only per-range totals
and the symbol table (bounded by the vocabulary) reach the driver.

Null and empty texts give the end id alone. Null ids come last; equal ids are ordered by text hash. Repeated rows
are all written. An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackweave.llm.common import batch_bytes, id_buckets, local_table, pieces, row_hash, stored
from stackweave.llm.tokens import encoder_of

U = np.uint64
SCALE, LANES, CHECK, BLOCK = 20, 1024, 1 << 16, 1 << 17
BATCH = 1 << 21  # bytes of blocks that go to Python at once, and one block more
_LOW = U(1 << 31)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 for each symbol that occurs."""
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((1 << SCALE) / max(counts.sum(), 1)))), 0).astype(np.int64)
    if counts.any():
        excess = int(freq.sum()) - (1 << SCALE)
        for s in np.argsort(-freq, kind="stable"):
            step = min(excess, int(freq[s]) - 1) if excess > 0 else excess
            freq[s] -= step
            excess -= step
            if not excess:
                break
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U)
        self.low = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """(states, payload, checkpoints) of one block; coded from the last id to the first."""
        x = np.full(LANES, _LOW, U)
        words, marks, total = [], [], 0
        at = ids.astype(np.intp)
        freqs, lows = self.freq.take(at), self.low.take(at)
        rests, most = U(1 << SCALE) - freqs, freqs << U(63 - SCALE)
        for start in range((len(ids) - 1) // LANES * LANES if len(ids) else -1, -1, -LANES):
            part = slice(start, start + LANES)
            f = freqs[part]
            v = x[:len(f)]
            full = np.flatnonzero(v >= most[part])
            if len(full):
                high = v.take(full)
                words.append(high.astype(np.uint32))  # the low half
                total += len(full)
                v[full] = high >> U(32)
            q = v // f
            q *= rests[part]
            v += q  # (v // f << SCALE) + v % f
            v += lows[part]
            if start and start % CHECK == 0:
                marks.append((total, x.tobytes()))
        payload = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        marks = b"".join(np.uint64(total - at).tobytes() + states for at, states in reversed(marks))
        return x.tobytes(), payload.astype("<u4").tobytes(), marks

    def decode(self, count: int, states: bytes, payload: bytes, start: int = 0) -> np.ndarray:
        """`count` ids from the given states; `start` is the payload position, as a checkpoint names it."""
        x = np.frombuffer(states, U).copy()
        words, at = np.frombuffer(payload, "<u4").astype(U), start
        out = np.empty(count, np.uint32)
        slots = U((1 << SCALE) - 1)
        for begin in range(0, count, LANES):
            n = min(LANES, count - begin)
            v = x[:n]
            slot = v & slots
            s = self.symbol.take(slot.view(np.int64))
            out[begin:begin + n] = s
            s = s.astype(np.intp)
            v >>= U(SCALE)
            v *= self.freq.take(s)
            v += slot
            v -= self.low.take(s)
            need = np.flatnonzero(v < _LOW)
            v[need] = (v.take(need) << U(32)) | words[at:at + len(need)]
            at += len(need)
        return out

    def decode_from(self, checkpoint: int, count: int, payload: bytes, checkpoints: bytes) -> np.ndarray:
        """Ids of a block from checkpoint number 0, 1, .. on (the first stands at id CHECK)."""
        width = 8 + 8 * LANES
        mark = checkpoints[checkpoint * width:(checkpoint + 1) * width]
        return self.decode(count - (checkpoint + 1) * CHECK, mark[8:], payload, int(np.frombuffer(mark[:8], U)[0]))


def _kind(docs: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    return docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)


def raw_blocks(docs: DataFrame, path: str, end: int, rows_per_file: int, max_files: int) -> DataFrame:
    """(file, block, start in the file, n_ids, docs, lengths, skipped, open, ids): the ids of every range, in order.

    An id takes two bytes where the vocabulary allows, else four. Rows stay small (256 KB, or 512): large ones fill the heap.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    number, files = id_buckets(docs, rows_per_file, max_files)
    kind, arrow = _kind(docs)
    tasks = max(1, min(files, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = docs.withColumn("file", number.cast("int")).repartition(tasks, "file").sortWithinPartitions(
        "file", F.asc_nulls_last("doc_id"), row_hash(F.col("text")))
    names = ["file", "block", "start", "n_ids", "docs", "lengths", "skipped", "open", "ids"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(arrow), pa.list_(pa.int32()), pa.int64(), pa.bool_(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        width = "<u2" if max(encoder.tokenizer.get_vocab(True).values(), default=0) < 1 << 16 and end < 1 << 16 else "<u4"
        file, block, start, skipped = None, 0, 0, 0
        held, docs_held, lengths, size = [], [], [], 0  # of the block that is being filled

        def row(n: int, going: bool) -> pa.RecordBatch:
            """The first n held ids as a block; the rest stays held."""
            nonlocal block, start, skipped, held, docs_held, lengths, size
            ids = held[0] if len(held) == 1 else np.concatenate(held)
            ends = np.cumsum(lengths)
            last = int(np.searchsorted(ends, n))
            inside = lengths[:last] + [n - int(ends[last] - lengths[last])]
            out = [file, block, start, n, docs_held[:last + 1], inside, skipped, going or int(ends[last]) > n, ids[:n].astype(width).tobytes()]
            rest = int(ends[last]) - n
            skipped = (skipped if last == 0 else 0) + inside[-1] if rest else 0
            docs_held, lengths = (docs_held[last:], [rest, *lengths[last + 1:]]) if rest else (docs_held[last + 1:], lengths[last + 1:])
            held, size, block, start = [ids[n:]], size - n, block + 1, start + n
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)], names)

        for batch, texts in pieces(batches):
            ids, counts = encoder.encode(texts)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            files, keys = batch.column("file").to_pylist(), batch.column("doc_id").to_pylist()
            for i, f in enumerate(files):
                if f != file:
                    if size:
                        yield row(size, False)
                    file, block, start, skipped, held, docs_held, lengths, size = f, 0, 0, 0, [], [], [], 0
                held += [ids[bounds[i]:bounds[i + 1]], np.array([end], np.uint32)]
                docs_held.append(keys[i])
                lengths.append(int(counts[i]) + 1)
                size += lengths[-1]
                while size >= BLOCK:
                    yield row(BLOCK, False)
        if size:
            yield row(size, False)

    return ordered.mapInArrow(cut, f"file int, block int, start long, n_ids int, docs array<{kind}>, lengths array<int>, skipped long, open boolean, ids binary")


def raw_ids(ids: pa.BinaryScalar, count: int) -> np.ndarray:
    """The `count` ids of a raw block, two or four bytes each."""
    body = ids.as_buffer()
    return np.frombuffer(body, f"<u{body.size // count}")


def frequencies(blocks: DataFrame) -> np.ndarray:
    """Frequency of each id, counted over all blocks; a task sends one row per id it meets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column("ids"), batch.column("n_ids").to_pylist()):
                found = np.bincount(raw_ids(ids, n))
                if len(found) > len(total):
                    total = np.concatenate((total, np.zeros(len(found) - len(total), np.int64)))
                total[:len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["symbol", "count"])

    with batch_bytes(blocks.sparkSession, BATCH):
        rows = blocks.select("ids", "n_ids").mapInArrow(count, "symbol int, count long").groupBy("symbol").agg(F.sum("count").alias("count")).toArrow()
    symbols = rows["symbol"].to_numpy()
    counts = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.int64)
    counts[symbols] = rows["count"].to_numpy()
    return normalised(counts)


def write_token_files(docs: DataFrame, path: str, end: int = 0, rows_per_file: int = 2000, max_files: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(blocks, table): the token files of all texts and their frequency table, both stored; `path` names the tokenizer."""
    spark = docs.sparkSession
    raw = stored(raw_blocks(docs, path, end, rows_per_file, max_files))
    freq = frequencies(raw)
    if len(freq) > 1 << SCALE - 1:
        raise ValueError("the vocabulary is too large for the frequency table")
    shared = spark.sparkContext.broadcast(freq)
    totals = [(r["file"], r["n"]) for r in raw.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()]
    before = np.concatenate(([0], np.cumsum([n for _, n in totals])))
    offsets = {f: int(b) for (f, _), b in zip(totals, before)}
    names = [c for c in raw.columns if c != "ids"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                ids = raw_ids(one.column("ids")[0], one.column("n_ids")[0].as_py()).astype("<u4")
                states, payload, marks = coder.encode(ids)
                start = one.column("start")[0].as_py() + offsets[one.column("file")[0].as_py()]
                columns = [pa.array([start], pa.int64()) if c == "start" else one.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([states]), pa.array([payload]), pa.array([marks]), pa.array([zlib.crc32(ids.tobytes())], pa.int64())],
                                                 [*names, "states", "payload", "checkpoints", "crc"])

    kind, _ = _kind(docs)
    with batch_bytes(spark, BATCH):
        blocks = stored(raw.mapInArrow(code, f"file int, block int, start long, n_ids int, docs array<{kind}>, lengths array<int>, skipped long, open boolean, "
                                             "states binary, payload binary, checkpoints binary, crc long"))
    seen = np.flatnonzero(freq)
    table = stored(local_table(spark, {"symbol": (pa.int32(), seen), "freq": (pa.int64(), freq[seen])}))
    return blocks, table


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, in its reflected form."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = b << 1 & 0xFFFFFFFF
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


def crc_join(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings one after another, from theirs and the length of the second."""
    shift, power = 0x80000000, 0x00800000  # 1 and x^8
    while size:
        if size & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        size >>= 1
    return _times(first, shift) ^ second


def read_documents(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; a damaged block raises an error.

    Blocks are decoded in parallel. The parts of a document that spans blocks meet by its start.
    """
    spark = blocks.sparkSession
    rows = table.toArrow()  # bounded by the vocabulary
    symbols = rows["symbol"].to_numpy()
    freq = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.int64)
    freq[symbols] = rows["freq"].to_numpy()
    shared = spark.sparkContext.broadcast(freq)
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["n_ids"], row["states"], row["payload"]).astype("<u4").tobytes()
                if zlib.crc32(ids) != row["crc"]:
                    raise ValueError(f"checksum of file {row['file']} block {row['block']}")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                part = np.zeros(len(ends), np.int64)
                part[0] = row["skipped"]
                whole = np.ones(len(ends), bool)
                whole[0] &= row["skipped"] == 0
                whole[-1] &= not row["open"]
                crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["docs"], batch.schema.field("docs").type.value_type), pa.array(row["start"] + begins - part), pa.array(np.array(row["lengths"], np.int64)),
                    pa.array(crcs, pa.int64()), pa.array(part), pa.array(whole)], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "whole"])

    found = blocks.select("file", "block", "start", "n_ids", "docs", "lengths", "skipped", "open", "states", "payload", "crc").mapInArrow(
        read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, part long, whole boolean")

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        def one(items) -> int:
            crc = 0
            for item in sorted(items, key=lambda x: x["part"]):
                crc = crc_join(crc, item["ids_crc32"], 4 * item["n_tokens"])
            return crc
        return parts.map(one)

    with batch_bytes(spark, BATCH):
        found = stored(found)
    # One row per block of a document that spans several.
    long = found.filter("NOT whole").groupBy("doc_id", "start").agg(F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct("part", "n_tokens", "ids_crc32")).alias("parts"))
    return found.filter("whole").select("doc_id", "start", "n_tokens", "ids_crc32").unionByName(long.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32")))


def token_report(docs: DataFrame, path: str, end: int = 0, **options) -> DataFrame:
    return read_documents(*write_token_files(docs, path, end, **options))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_files(spark, folder):
    from stackweave.llm.common import read
    return token_report(read(spark, folder, "documents"), default_tokenizer())
