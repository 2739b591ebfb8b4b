"""N-gram Jaccard join by token-combination prefixes, and near-duplicate components.

A document's set holds the hashes of its distinct word shingles. Tokens (shingles) are ordered by how often they
are repeated in the corpus. A prefix filter says that two similar sets share a token among their first
few; here the prefix is extended where it reaches frequent tokens, and those are indexed only in combinations:

* rare tokens are indexed one by one;
* frequent tokens fall into classes that are indexed as pairs and triples. A class is dealt by token hash into
  subclasses, so the number of combinations stays in proportion to the prefix. A subclass with c tokens in the
  prefix covers c - k + 1 of the tokens that a partner may miss; the prefix ends when all of them are covered.

Documents with one set are one node (joined before the shuffle, any number of copies costs nothing). The smaller set
of a pair looks up a shorter prefix (index role) than the larger (probe role); combinations are kept apart by size
band, which also decides the number of subclasses. A short list of sets that share a signature gives all its pairs
that lengths, roles and positions allow. A long list is first linked to leaders (smallest set first, a new leader where
sizes leave its reach). Verified links make provisional components; after that every remaining pair of a long list
that spans two components is formed and verified. Pairs inside a component cannot change the result, and a parity bitmap of each set bounds what a pair can share, so a
large group of near copies costs a bounded number of pairs for each member, not one for each pair.

Most signatures occur once in the corpus and can link nothing. They are made twice: a first pass counts them, as sorted
34-bit cells of about two bytes each, up to two per cell; a second pass sends on only those whose bit is set in a
table of 2^28 bits (32 MB at any corpus size). Cells and bits can be shared, so single signatures may pass (more of
them the larger the corpus), but no repeated one is lost.

The frequency table is a sum, over all documents, of repeats that tasks see; at most `frequent` tokens of highest count
are kept. It decides only the order of tokens, never which links are found.

Null, empty and word-free texts have an empty set and link with nothing. Rows with null ids take part; a component's
id is its smallest non-null doc_id. Equal rows are one node, each row keeps its own result row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackweave.llm import words as W
from stackweave.llm.common import pieces, row_hash, stored
from stackweave.llm.components import components

U = np.uint64
PAIR_FROM, TRIPLE_FROM = 64, 4096  # repeats from which tokens are indexed as pairs, as triples
_FLUSH = 4 << 20
BROADCAST_ROWS = 500_000
LEADER_ROUNDS = 2
PART_PAIRS = 64  # pairs of one set that are verified by one task in a row
CELL_BITS, TABLE_BITS, CHUNK_BITS = 34, 28, 10  # cells that count signatures, bits that are broadcast, chunks of cells


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer words is one shingle."""
    words = W.split(texts, W.SPACES, lower=True)
    at, hashes = words.windows(size)
    first = np.searchsorted(at, words.first)
    out = []
    for row in range(len(words.first) - 1):
        a, b = int(words.first[row]), int(words.first[row + 1])
        if 0 < b - a < size:
            out.append(words.ranges(np.array([a]), np.array([b])))
        else:
            h = np.sort(hashes[first[row]:first[row + 1]])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
    return out


def set_id(tokens: np.ndarray) -> int:
    """A hash of the whole set, 0 for the empty one."""
    if not len(tokens):
        return 0
    total = W.mix(tokens ^ U(0x2545F4914F6CDD1D)).sum(keepdims=True, dtype=U)
    return int(W.mix(total + np.array([len(tokens)], U) * U(0x9FB21C651E98DF25)).view(np.int64)[0])


def parities(tokens: np.ndarray) -> np.ndarray:
    """1024 bits, each the parity of the tokens that fall on it: two sets differ in as many tokens as bits at least."""
    return np.packbits((np.bincount((tokens >> U(54)).astype(np.int64), minlength=1024) & 1).astype(bool)).view(np.int64)


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, n_shingles, set, bits): one row per document row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
                                              pa.array([parities(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "row", "n_shingles", "set", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_hash(F.col("text")).alias("row")).mapInArrow(find, f"doc_id {kind}, row long, n_shingles long, set long, bits array<long>")


def repeated_tokens(docs: DataFrame, size: int) -> DataFrame:
    """(token, repeats): tokens that some task meets in several sets, with the sum of those counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def flush():
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()  # in place: most tokens are single, so only the repeated ones are copied
            again = np.flatnonzero(tokens[1:] == tokens[:-1])
            tokens, counts = np.unique(tokens[again], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array((counts + 1).astype(np.int64))], ["token", "repeats"])

        for _, texts in pieces(batches):
            for tokens in shingle_sets(texts, size):
                key = set_id(tokens)
                if key and key not in seen:
                    seen.add(key)
                    held.append(tokens)
                    total += len(tokens)
            if total > _FLUSH:
                yield flush()
                held, total, seen = [], 0, set()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "token long, repeats long").groupBy("token").agg(F.sum("repeats").alias("repeats"))


def frequency_table(docs: DataFrame, size: int, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated tokens, `frequent` at most (12 bytes each), sorted by token, and their counts.

    The least count is chosen from a histogram so that the table keeps its bound.
    """
    counted = stored(repeated_tokens(docs, size))
    level, total = 2, 0
    for row in counted.groupBy(F.floor(F.log2("repeats") * 4).alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > frequent:
            level = int(np.ceil(2 ** ((row["level"] + 1) / 4)))
            break
    table = counted.filter(F.col("repeats") >= level).toArrow()
    tokens = table["token"].to_numpy().view(U)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(table["repeats"].to_numpy()[order], 1 << 31).astype(np.uint32)


def _band(n: int) -> int:
    return int(np.floor(np.log(n + 1e-9) / np.log(4 / 3) + 1e-9))


class Signer:
    """Signatures of one set: (signature, position or -1, role), role 1 index, 2 probe, 3 both."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, threshold: tuple[int, int], pair_from: int = PAIR_FROM, triple_from: int = TRIPLE_FROM):
        self.tokens, self.counts, self.threshold = tokens, counts, threshold
        self.pair_from, self.triple_from = pair_from, triple_from
        self.map = np.zeros(1 << 22, bool)
        self.map[tokens >> U(42)] = True

    def allowed(self, n: int, m: int) -> int:
        """Tokens of a set of n that a partner of m may miss: n less the least intersection."""
        a, b = self.threshold  # intersection >= a / b of the union
        return n - -(-a * (n + m) // (a + b))

    def sign(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(tokens)
        a, b = self.threshold
        smallest = -(-a * n // b)
        miss = {2: self.allowed(n, smallest), 1: self.allowed(n, n)}
        counts = np.zeros(n, np.int64)
        maybe = np.flatnonzero(self.map[tokens >> U(42)])
        if len(maybe) and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            counts[maybe] = np.where(self.tokens[at] == tokens[maybe], self.counts[at], 0)
        if counts.any():
            order = np.lexsort((tokens, counts))
            tokens, counts = tokens[order], counts[order]
        rare = int(np.searchsorted(counts, self.pair_from))
        singles = {r: min(rare, miss[r] + 1) for r in miss}
        length = max(singles.values())
        sigs, places = [tokens[:length]], [np.arange(length)]
        roles = [np.where(np.arange(length) < singles[1], 3, 2)]
        for role in (1, 2):
            if rare >= miss[role] + 1:
                continue
            for band in range(_band(n if role == 1 else smallest), _band(n) + 1):
                low = (4 / 3) ** band
                if low < 16:  # all tokens count as rare in a band of small sets
                    extra = np.arange(rare, min(n, miss[role] + 1))
                    found = tokens[extra]
                else:
                    found = self._combined(tokens, counts, rare, miss[role] + 1 - rare, band, max(1, int(low / 16)))
                    extra = np.full(len(found), -1)
                sigs.append(found)
                places.append(extra)
                roles.append(np.full(len(found), role))
        return np.concatenate(sigs), np.concatenate(places), np.concatenate(roles)

    def _combined(self, tokens, counts, at: int, cover: int, band: int, parts: int) -> np.ndarray:
        held: dict[tuple[int, int], list[int]] = {}
        while cover > 0 and at < len(tokens):
            k = 3 if counts[at] >= self.triple_from else 2
            key = (k, int((tokens[at] >> U(17)) % U(parts)))
            held.setdefault(key, []).append(int(tokens[at]))
            cover -= len(held[key]) >= k
            at += 1
        found = [[c[0], c[1], c[2] if k == 3 else 0, k] for (k, _), group in held.items() for c in combinations(sorted(group), k)]
        if not found:
            return np.zeros(0, U)
        f = np.array(found, U)
        return W.mix(f[:, 0] + W.mix(f[:, 1] + W.mix(f[:, 2] + f[:, 3] * U(0x9E3779B97F4A7C15) + U(band * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))))


def _signed_sets(batches: Iterator[pa.RecordBatch], size: int, signs: Signer) -> Iterator[list[tuple]]:
    """Runs of (set, n, signatures, positions, roles); of equal sets of a task the first only, as long as it remembers."""
    seen = set()
    for _, texts in pieces(batches):
        rows = []
        for tokens in shingle_sets(texts, size):
            key = set_id(tokens)
            if key and key not in seen:
                if len(seen) < 1 << 20:
                    seen.add(key)
                rows.append((key, len(tokens), *signs.sign(tokens)))
        if rows:
            yield rows


def repeated_signatures(docs: DataFrame, size: int, signer) -> np.ndarray:
    """A table of 2^28 bits, packed, with a bit set wherever a signature of two sets falls (tables of tasks are merged in Spark).

    Of each chunk of cells a task holds one byte a cell (16 MB) and 32 KB of it reach the driver.
    """
    low = CELL_BITS - CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            cells = W.mix(np.concatenate(held)) >> U(64 - CELL_BITS)
            cells.sort()
            third = np.zeros(len(cells), bool)
            third[2:] = (cells[2:] == cells[1:-1]) & (cells[2:] == cells[:-2])
            cells = cells[~third]  # two of a cell say all
            chunk = (cells >> U(low)).astype(np.int32)
            starts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            rest = (cells & U((1 << low) - 1)).astype(np.int64)
            gaps = np.diff(rest, prepend=0)
            gaps[starts] = rest[starts]
            gaps = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)
            ends = np.append(starts[1:], len(cells))
            packed = [gaps[a:b].T.tobytes() for a, b in zip(starts.tolist(), ends.tolist())]  # bytes of one rank together
            return pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array(packed, pa.binary())], ["chunk", "gaps"])

        for rows in _signed_sets(batches, size, signer()):
            held += [r[2] for r in rows]
            total += sum(len(r[2]) for r in rows)
            if total > 1 << 20:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, bits = None, np.zeros(1 << low, bool), np.zeros(1 << (TABLE_BITS - CHUNK_BITS), bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for now, gaps in zip(batch.column("chunk").to_pylist(), batch.column("gaps")):
                if now != chunk:
                    if chunk is not None:
                        yield done()
                    chunk = now
                    seen[:] = bits[:] = False
                at = np.cumsum(np.frombuffer(gaps.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64))
                again = np.concatenate(([False], at[1:] == at[:-1]))
                bits[at[again | seen[at]] >> (CELL_BITS - TABLE_BITS)] = True
                seen[at] = True
        if chunk is not None:
            yield done()

    counted = docs.select("text").mapInArrow(count, "chunk int, gaps binary").repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros((1 << CHUNK_BITS, 1 << (TABLE_BITS - CHUNK_BITS - 3)), np.uint8)
    for row in counted.mapInArrow(merge, "chunk int, bits binary").toLocalIterator():
        table[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def signatures(docs: DataFrame, size: int, signer, repeated) -> DataFrame:
    """(sig, set, n, pos, role) of all distinct sets, without signatures that `repeated` (a table's getter) shows to be single."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = repeated()
        for rows in _signed_sets(batches, size, signer()):
            lengths = np.array([len(r[2]) for r in rows])
            sigs = np.concatenate([r[2] for r in rows])
            place = W.mix(sigs) >> U(64 - TABLE_BITS)
            kept = (table[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([
                pa.array(sigs[kept].view(np.int64)), pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), lengths)[kept]),
                pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), lengths)[kept]), pa.array(np.concatenate([r[3] for r in rows]).astype(np.int32)[kept]),
                pa.array(np.concatenate([r[4] for r in rows]).astype(np.int8)[kept])], ["sig", "set", "n", "pos", "role"])

    return docs.select("text").mapInArrow(find, "sig long, set long, n int, pos int, role byte")


def candidates(signed: DataFrame, threshold: tuple[int, int], longest: int = 64) -> DataFrame:
    """Pairs, and rows of long lists: (sig, set, n, pos, role, leader).

    A signature's list of at most `longest` sets gives its pairs at once (sig null, the pair in set and leader). A longer
    list keeps its rows, each with the leader that it is to be compared with first (or null). Rows come sorted by
    signature and are streamed, so a list of any length takes no more memory than `longest` rows.
    """
    a, b = threshold
    names = ("sig", "set", "n", "pos", "role")

    def fits(n, p, role, m, q, other):
        """Whether two sets may be similar: roles, lengths and positions (the first set is not the larger one)."""
        return ((other > 1) & (role != 2) & (b * n >= a * m) & ((p < 0) | (q < 0) | (np.minimum(n - p, m - q) * (a + b) >= a * (n + m)))
                | (n == m) & (role > 1) & (other != 2) & ((p < 0) | (q < 0) | (np.minimum(n - p, m - q) * (a + b) >= a * (n + m))))

    def pairs(sig, node, n, pos, role):
        found = []
        for step in range(1, longest):
            at = np.flatnonzero(sig[step:] == sig[:-step]) if step < len(sig) else np.zeros(0, np.int64)
            if not len(at):
                break
            to = at + step
            good = (node[at] != node[to]) & fits(n[at], pos[at], role[at], n[to], pos[to], role[to])
            found.append((node[at[good]], node[to[good]]))
        return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long, leader = None, None, None  # rows of a list that may go on; the signature of a long list; its leader

        def rows(columns, mask) -> tuple[list[np.ndarray], np.ndarray]:
            nonlocal leader
            kept = [c[mask] for c in columns]
            leaders = np.zeros(len(kept[0]), np.int64)
            for i, (s, x, size, p) in enumerate(zip(*(c.tolist() for c in kept[:4]))):
                if leader is None or leader[0] != s or leader[2] * b < a * size:
                    leader = (s, x, size, p)
                elif x != leader[1] and (p < 0 or leader[3] < 0 or min(size - p, leader[2] - leader[3]) * (a + b) >= a * (size + leader[2])):
                    leaders[i] = leader[1]
            return kept, leaders

        def out(columns, done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, long
            sig = columns[0]
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            lengths = np.diff(np.append(starts, len(sig)))
            lasting = lengths > longest
            lasting[0] |= long is not None and sig[0] == long
            stop = len(sig)
            if not done:
                long = sig[-1] if lasting[-1] else None
                stop = len(sig) if lasting[-1] else int(starts[-1])
                held = None if lasting[-1] else [c[stop:] for c in columns]
            mask = np.repeat(lasting, lengths)
            kept, leaders = rows(columns, mask)
            if len(leaders):
                yield pa.RecordBatch.from_arrays([*map(pa.array, kept), pa.array(leaders, mask=leaders == 0)], [*names, "leader"])
            mask = ~mask & np.repeat(lengths > 1, lengths)
            mask[stop:] = False
            x, y = pairs(*(c[mask] for c in columns))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int8()), pa.array(y)],
                                                 [*names, "leader"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            if len(columns[0]):
                yield from out(columns, False)
        if held is not None and len(held[0]):
            yield from out(held, True)

    ordered = signed.repartition("sig").sortWithinPartitions("sig", "n", "set")
    return ordered.mapInArrow(run, "sig long, set long, n int, pos int, role byte, leader long")


def _room(a: int, b: int) -> str:
    """SQL: whether the parity bits of two sets leave room for the threshold."""
    return (f"(x_n + y_n - aggregate(zip_with(x_bits, y_bits, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)) * {a + b} >= {2 * a} * (x_n + y_n)")


def set_bits(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(set, bits) of the sets that occur in `rows`, each once."""
    wanted = rows.select("set").distinct()
    few = wanted.count() <= BROADCAST_ROWS  # 8 bytes each; beyond that the bits of all sets are shuffled
    return sets.select("set", "bits").join(F.broadcast(wanted) if few else wanted, "set").dropDuplicates(["set"])


def set_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set, text): the text of each chosen set, that of its first document (d, r)."""
    count, copies = chosen.agg(F.count(F.lit(1)), F.max("copies")).first()
    few = count <= BROADCAST_ROWS  # 24 bytes each; beyond that the texts are shuffled
    place = chosen.select("set", "d", "r")
    texts = docs.select("doc_id", "text", row_hash(F.col("text")).alias("row"))
    named = texts.join(F.broadcast(place) if few else place, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select("set", "text")
    return named.dropDuplicates(["set"]) if (copies or 0) > 1 else named


def dealt(pairs: DataFrame) -> DataFrame:
    """(a, part, lead, set): the pairs of one set a in parts of about `PART_PAIRS`, a itself at the head of each part."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART_PAIRS).alias("parts"))
    cut = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
    heads = cut.select("a", "part").distinct().select("a", "part", F.lit(True).alias("lead"), F.col("a").alias("set"))
    return heads.unionByName(cut.select("a", "part", F.lit(False).alias("lead"), F.col("b").alias("set")))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold, as a stored table.

    Pairs that the parity bits rule out go first. The texts of the others are shuffled once, to the part that compares them
    (`dealt`); sets are made there, since eight random bytes a shingle are twice a packed text and more.
    """
    a, b = threshold
    pairs = stored(pairs)
    named = sets.join(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "set")
    chosen = stored(named.groupBy("set", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n")).groupBy("set").agg(
        F.min_by(F.struct(F.col("doc_id").alias("d"), F.col("row").alias("r"), "copies", "bits", "n"), F.struct("doc_id", "row")).alias("one")).select("set", "one.*"))

    def side(name: str, prefix: str) -> DataFrame:
        return chosen.select(F.col("set").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in ("bits", "n")])

    pairs = stored(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(_room(a, b)).select("a", "b"))
    left_over = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    texts = set_texts(docs, stored(chosen.join(left_over, "set", "left_semi").drop("bits", "n")))
    members = stored(dealt(pairs))
    few = members.count() <= BROADCAST_ROWS
    rows = texts.join(F.broadcast(members) if few else members, "set").select("a", "part", "lead", "set", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch, texts in pieces(batches):
            good = []
            for lead, tokens in zip(batch.column("lead").to_pylist(), shingle_sets(texts, size)):
                if lead:
                    head = tokens
                    good.append(False)
                    continue
                joined = np.sort(np.concatenate((head, tokens)), kind="stable")
                both = int((joined[1:] == joined[:-1]).sum())
                good.append(b * both >= a * (len(joined) - both))
            found = batch.select(["a", "set"]).filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, ["a", "b"])

    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead"), "set")
    return stored(ordered.mapInArrow(check, "a long, b long"))


def near_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (3, 4), frequent: int = 1 << 20,
                    pair_from: int = PAIR_FROM, triple_from: int = TRIPLE_FROM) -> DataFrame:
    """(doc_id, row, n_shingles, set, root, component_id) of every document row; rows of one root are one component; `threshold` is a fraction, 3/4 for 0.75."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    sets = stored(document_sets(docs, size))
    table = context.broadcast(frequency_table(docs, size, frequent))

    def signer() -> Signer:
        return Signer(*table.value, threshold, pair_from, triple_from)

    repeated = context.broadcast(repeated_signatures(docs, size, signer))
    found = stored(candidates(signatures(docs, size, signer, lambda: repeated.value), threshold))
    table.unpersist()  # the signatures are written: executors and workers need both tables no more
    repeated.unpersist()
    first = found.filter("leader IS NOT NULL").select(F.least("set", "leader").alias("a"), F.greatest("set", "leader").alias("b")).distinct()
    links = verified(first, docs, sets, size, threshold)
    roots = stored(components(links))
    lists = stored(found.filter("sig IS NOT NULL").select("sig", "set", "n", "pos", "role").distinct())
    a, b = threshold
    fits = (f"x_root != y_root AND least(x_n, y_n) * {b} >= {a} * greatest(x_n, y_n) AND "
            f"(x_pos < 0 OR y_pos < 0 OR least(x_n - x_pos, y_n - y_pos) * {a + b} >= {a} * (x_n + y_n))")
    ordered = "(x_n > y_n OR x_n = y_n AND x_set > y_set)"

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        return rows.select("sig", *[F.col(c).alias(f"{name}_{c}") for c in ("set", "n", "pos", "root", *more)])

    for turn in range(LEADER_ROUNDS + 1):
        # Rows of one set side by side: what repeats in them takes little room in the shuffles by signature.
        marked = stored(lists.join(roots, lists["set"] == roots["node"], "left").select(*lists.columns, F.coalesce("root", "set").alias("root")).sortWithinPartitions("set"))
        leaders = stored(marked.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(
            F.struct("set", "n", "pos", "root"), F.xxhash64("set", F.pmod("sig", F.lit(8)), F.lit(turn))).alias("one")).filter("low != high").select("sig", "one.*"))
        if leaders.isEmpty():
            break
        if turn < LEADER_ROUNDS:  # a few leaders for the whole corpus: few different pairs for each member
            pairs = side(marked, "x").join(side(leaders, "y"), "sig").filter(fits)
        else:  # whatever still spans two components; only here the parity bits travel with the rows
            wide = marked.join(leaders.select("sig"), "sig", "left_semi").join(set_bits(sets, marked), "set")
            pairs = side(wide.filter("role > 1"), "x", "bits").join(side(wide.filter("role != 2"), "y", "bits"), "sig").filter(f"{fits} AND {ordered} AND {_room(a, b)}")
        new = verified(pairs.select(F.least("x_set", "y_set").alias("a"), F.greatest("x_set", "y_set").alias("b")).distinct(), docs, sets, size, threshold)
        roots = stored(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)))
    named = sets.join(roots, sets["set"] == roots["node"], "left").withColumn("root", F.coalesce("root", "set"))
    smallest = named.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least_doc"))
    return named.join(smallest, "root", "left").select("doc_id", "row", "n_shingles", "set", "root", F.when(F.col("n_shingles") > 0, F.col("least_doc")).otherwise(F.col("doc_id")).alias("component_id"))


def near_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id."""
    return near_components(docs, **options).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each component: that of the smallest id (of repeated ids, the one of least text hash).

    Documents with an empty set stay, and so do documents without an id, which stand for no component.
    """
    kept = near_components(docs, **options).filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("one")).select(
        F.col("one.doc_id").alias("doc_id"), F.col("one.row").alias("__row"))
    empty = F.length(F.trim(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     "))) == 0
    marked = docs.withColumn("__row", row_hash(F.col("text").cast("string")))
    loose = marked.filter(empty | F.col("doc_id").isNull()).drop("__row")
    chosen = marked.filter(~empty & F.col("doc_id").isNotNull()).join(kept, ["doc_id", "__row"], "left_semi").dropDuplicates(["doc_id", "__row"])
    return chosen.select(docs.columns).unionByName(loose.select(docs.columns))


def op4_ngram_jaccard_join(spark, folder):
    from stackweave.llm.common import read
    return near_report(read(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
                     FROM (SELECT *, row_number() OVER () AS r FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT r, md5(array_to_string(words[i:i + 4], ' ')) AS shingle FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY x.r, y.r) p
          JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT r, r AS other FROM w UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN w o ON o.r = reach.other GROUP BY reach.r) c ON c.r = w.r
"""
