"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends, of at least `least` words and `times` periods. Per text:

1. Word ids, equal for identical words only (equal hashes are compared byte by byte).
2. Re-Pair: the most frequent pair of neighbouring symbols becomes a nonterminal, until no pair occurs twice. A
   nonterminal's places in the derivation are the places where it was put, so they are known when it is made.
3. What is left, the start rule, is split in halves down to single symbols: nonterminals with one place each.
4. A run lies in the expansion of the smallest nonterminal that holds it and crosses the border of its two parts.
   So each nonterminal is searched once, at its border: periods whose border pair recurs are tried, and equal
   stretches are grown both ways inside the expansion.
5. The runs of a nonterminal are translated to all its places; intervals of one period that share a period or more
   are merged, which leaves the maximal ones.

A run holds five words that recur in the text; a text in which no five words recur has no run and needs no
grammar. All steps before and after step 2 work on arrays of many texts at once.

Null texts have no words. Empty tables give no rows, repeated rows repeated results; ties of length go to the
smallest start, then period. A text is held whole by one task, with about 200 bytes a word while its grammar is made.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from stackweave.llm import words as W
from stackweave.llm.common import pieces
from stackweave.llm.repeats import _text_sha as text_sha

_GRAM = 5  # a run of `least` words and `times` periods holds this many words twice
_BLOCK = 1 << 20
_NOTHING = np.zeros((0, 3), np.int64)


def word_ids(words: W.Words) -> np.ndarray:
    """Dense numbers, equal exactly for words of equal bytes."""
    if not len(words.hashes):
        return np.zeros(0, np.int64)
    _, first, ids = np.unique(words.hashes, return_index=True, return_inverse=True)
    size, twin = words.ends - words.starts, first[ids]
    same = (size == size[twin]).all()
    if same:
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = (words.data[np.repeat(words.starts, size) + step] == words.data[np.repeat(words.starts[twin], size) + step]).all()
    if not same:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(words.text(i), len(known)) for i in range(len(size))], np.int64)
    return ids.astype(np.int64)


def repair(symbols: list[int], groups: list[list[int]], fresh: int) -> tuple[list[tuple[int, int, list[int]]], list[int]]:
    """Re-Pair of one text: its nonterminals as (size of the left part, size, places), and the places of the start rule.

    `groups` holds the places of every pair that occurs twice or more; `fresh` is the first free symbol. Places are
    word numbers, also inside the grammar: a symbol stands where its first word stood.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    where = {(symbols[g[0]], symbols[g[0] + 1]): g for g in groups}
    heap = [(-len(g), g[0], pair) for pair, g in where.items()]
    heapify(heap)
    sizes: dict[int, int] = {}
    rules = []
    while heap:
        count, _, pair = heappop(heap)
        a, b = pair
        live, taken = [], -1
        for p in where.pop(pair):
            if symbols[p] == a and p != taken:
                q = after[p]
                if q < n and symbols[q] == b:
                    live.append(p)
                    taken = q
        if len(live) < 2:
            continue
        if len(live) < -count:  # some places went to other pairs: wait for its turn
            where[pair] = live
            heappush(heap, (-len(live), live[0], pair))
            continue
        left = sizes.get(a, 1)
        size = left + sizes.get(b, 1)
        for p in live:
            q = after[p]
            r = after[q]
            symbols[p], symbols[q] = fresh, -1
            after[p] = r
            if r < n:
                before[r] = p
        beside = defaultdict(list)
        for p in live:
            q = before[p]
            if q >= 0:
                beside[symbols[q], fresh].append(q)
            q = after[p]
            if q < n and symbols[q] != fresh:
                beside[fresh, symbols[q]].append(p)
        for pair, places in beside.items():
            if len(places) > 1:
                where[pair] = places
                heappush(heap, (-len(places), places[0], pair))
        sizes[fresh] = size
        rules.append((left, size, live))
        fresh += 1
    return rules, [p for p, s in enumerate(symbols) if s >= 0]


def halves(places: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Nodes (low, border, high) of balanced trees over the start rules of many texts.

    `places` are the symbols' places, text by text; text k's are first[k] .. first[k + 1] and its words end at ends[k].
    """
    counts, nodes, width = np.diff(first), [np.zeros((0, 3), np.int64)], 1
    bounds = np.append(places, 0)
    while len(counts) and width < counts.max():
        number = np.where(counts > width, (counts - width + 2 * width - 1) // (2 * width), 0)
        text = np.repeat(np.arange(len(counts)), number)
        low = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * 2 * width
        high = low + 2 * width
        nodes.append(np.stack([bounds[first[text] + low], bounds[first[text] + low + width],
                               np.where(high < counts[text], bounds[np.minimum(first[text] + high, len(places))], ends[text])], 1))
        width *= 2
    return np.concatenate(nodes)


def _equal(ids: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many words from a and from b on (in direction `step`) are equal, `limit` at most."""
    done, size = 0, 32
    while done < limit:
        size = min(size, limit - done)
        if step > 0:
            differ = ids[a + done:a + done + size] != ids[b + done:b + done + size]
        else:
            differ = (ids[a - done - size + 1:a - done + 1] != ids[b - done - size + 1:b - done + 1])[::-1]
        found = int(differ.argmax())
        if differ[found]:
            return done + found
        done += size
        size *= 4
    return limit


def border_runs(ids: np.ndarray, nodes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, run) rows: the runs (start, end, period) inside each node's expansion that cross its border."""
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:] if len(ids) else ids
    low, border, high = nodes.T
    found_node, found = [], []
    for right in (True, False):
        most = np.minimum((high - low) // times, (high - border if right else border - low) // 2)
        begin = 0
        while begin < len(nodes):  # about _BLOCK (node, period) tries at a time
            stop = max(begin + 1, int(np.searchsorted(np.cumsum(most[begin:]), _BLOCK, "right")) + begin)
            node = np.repeat(np.arange(begin, stop), most[begin:stop])
            q = np.arange(len(node)) - np.repeat(np.cumsum(most[begin:stop]) - most[begin:stop], most[begin:stop]) + 1
            at = border[node] - 1 if right else border[node] - 1 - q  # words at and at + q are equal in a run of period q
            keep = pairs[at] == pairs[at + q]
            node, q, at = node[keep], q[keep], at[keep]
            far = at + q if right else at - q + 1
            keep = (ids[far] == ids[far + q]) & (ids[at + (q // 2 if right else -(q // 2))] == ids[at + (q // 2 if right else -(q // 2)) + q])
            begin, last, known = stop, -1, []
            for k, period, i in zip(node[keep].tolist(), q[keep].tolist(), at[keep].tolist()):
                if k != last:
                    last, known = k, []
                    lo, mid, hi = nodes[k].tolist()
                if any(period % p == 0 and (e - mid if right else mid - s) >= period for s, e, p in known):
                    continue  # a multiple of a period seen to hold here
                end = i + period + _equal(ids, i, i + period, hi - period - i, 1)
                start = i + 1 - _equal(ids, i, i + period, i - lo + 1, -1)
                if end - start >= max(least, times * period):
                    known.append((start, end, period))
                    found_node.append(k)
                    found.append((start, end, period))
    return np.array(found_node, np.int64), np.array(found, np.int64).reshape(-1, 3)


def merged(runs: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end, period) by start, then period, from parts that may overlap."""
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    out: list[list[int]] = []
    for start, end, period in runs.tolist():
        if out and out[-1][2] == period and start + period <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, period])
    shortest: dict[tuple[int, int], int] = {}
    for start, end, period in out:  # periods ascend: of equal intervals the smallest period stays
        shortest.setdefault((start, end), period)
    return np.array(sorted((s, e, q) for (s, e), q in shortest.items()), np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> list[np.ndarray]:
    """Maximal runs of each text, as (start, end, period) with words numbered from the text's first one."""
    if times < 4 or least < _GRAM + 1:  # two periods of a run stand on one side of any border in it
        raise ValueError(f"runs are found from 4 periods and {_GRAM + 1} words on")
    none = [_NOTHING] * (len(first) - 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(len(ids) - _GRAM + 1, 0))
    at = at[text[at] == text[at + _GRAM - 1]] if len(at) else at
    grams = text[at].astype(W.U)
    for k in range(_GRAM):
        grams = W.mix(grams * W.U(0x9E3779B97F4A7C15) + ids[at + k].astype(W.U))
    order = np.argsort(grams, kind="stable")
    again = order[1:][grams[order[1:]] == grams[order[:-1]]]
    chosen = np.unique(text[at[again]])
    if not len(chosen):
        return none
    # The chosen texts, closed up.
    size = np.diff(first)[chosen]
    bounds = np.concatenate(([0], np.cumsum(size)))
    words = np.arange(bounds[-1]) + np.repeat(first[chosen] - bounds[:-1], size)
    ids, text = ids[words], np.repeat(np.arange(len(chosen)), size)
    kinds = int(ids.max()) + 1
    at = np.flatnonzero(text[1:] == text[:-1])
    keys = (text[at] * kinds + ids[at]) * kinds + ids[at + 1]
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))
    counts = np.diff(np.append(edge, len(order)))
    edge, counts = edge[counts > 1], counts[counts > 1]
    owner = text[at[order[edge]]]
    split = np.searchsorted(owner, np.arange(len(chosen) + 1)).tolist()
    places, edge, counts = (at[order] - bounds[text[at[order]]]).tolist(), edge.tolist(), counts.tolist()
    nodes, rules, starts, first_start = [], [], [], [0]
    for t in range(len(chosen)):
        base = int(bounds[t])
        groups = [places[edge[g]:edge[g] + counts[g]] for g in range(split[t], split[t + 1])]
        made, start = repair(ids[base:int(bounds[t + 1])].tolist(), groups, kinds)
        for left, length, found in made:
            if length >= least:
                nodes.append((base + found[0], base + found[0] + left, base + found[0] + length))
                rules.append(found)
        starts.append(np.array(start, np.int64) + base)
        first_start.append(first_start[-1] + len(start))
    trees = halves(np.concatenate(starts), np.array(first_start), bounds[1:])
    trees = trees[trees[:, 2] - trees[:, 0] >= least]
    nodes = np.concatenate([np.array(nodes, np.int64).reshape(-1, 3), trees])
    node, runs = border_runs(ids, nodes, least, times)
    parts: list[list[np.ndarray]] = [[] for _ in chosen]
    for k, (start, end, period) in zip(node.tolist(), runs.tolist()):
        t = int(text[start])
        moved = np.array(rules[k]) + (start - nodes[k, 0]) if k < len(rules) else np.array([start - bounds[t]])
        parts[t].append(np.stack([moved, moved + end - start, np.full(len(moved), period)], 1))
    for t, found in zip(chosen.tolist(), parts):
        if found:
            none[t] = merged(np.concatenate(found))
    return none


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """True at the words that lie in a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


Order = Callable[[object, int], "np.ndarray | None"]


def _texts(batches: Iterator[pa.RecordBatch], order: Order | None, least: int, times: int):
    """Per piece of rows: the batch, its words, the words' order in the texts, and each text's runs."""
    for batch, texts in pieces(batches):
        words = W.split(texts, W.SPACES)
        sequence = np.arange(len(words.starts))
        if order is not None:
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                base, n = int(words.first[row]), int(words.first[row + 1] - words.first[row])
                moved = order(doc_id, n)
                if moved is not None:
                    sequence[base:base + n] = base + moved
        yield batch, words, sequence, find_runs(word_ids(words)[sequence], words.first, least, times)


def runs_of(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, start, length, period) of every run of every document row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, runs in _texts(batches, None, least, times):
            every = np.concatenate(runs) if runs else _NOTHING
            row = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(every[:, 0]), pa.array(every[:, 1] - every[:, 0]), pa.array(every[:, 2])],
                                             ["doc_id", "start", "length", "period"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, period long")


def collapse_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """`docs` with each run cut to its first period: changed texts hold their kept words joined by one space; others stay as they are."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, _, runs in _texts(batches, None, least, times):
            out = batch.column("text").to_pylist()
            for row, found in enumerate(runs):
                if len(found):
                    base, n = int(words.first[row]), int(words.first[row + 1] - words.first[row])
                    out[row] = b" ".join(words.text(int(w)) for w in np.flatnonzero(~_dropped(found, n)) + base).decode()
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(rows, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def run_report(docs: DataFrame, order: Order | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of every document row.

    `order(doc_id, n)` may rearrange the n words of a text before they are searched; None leaves them as they are.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, sequence, runs in _texts(batches, order, least, times):
            out = []
            for row, found in enumerate(runs):
                base, n = int(words.first[row]), int(words.first[row + 1] - words.first[row])
                length = found[:, 1] - found[:, 0]
                best = int(length.argmax()) if len(found) else None  # the first of the longest: smallest start, then period
                text = "".join(f"{s},{e - s},{q}\n" for s, e, q in found.tolist())
                out.append((len(found), *((None,) * 4 if best is None else (
                    int(found[best, 0]), int(length[best]), int(found[best, 2]), 1000 * int(length[best]) // int(found[best, 2]))),
                    hashlib.sha256(text.encode()).hexdigest(), text_sha(words, sequence[base:base + n][~_dropped(found, n)])))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                                             ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def planted(doc_id, n: int) -> np.ndarray | None:
    """Word order that makes every tenth text periodic from some word on (by crc32 of the id; a null id as the empty string)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark, folder):
    from stackweave.llm.common import read
    return run_report(read(spark, folder, "documents"), planted)


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, CAST(i AS INTEGER), 1)) AS BIGINT))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) AS h FROM t),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, h // 10 AS g FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT r, doc_id, n, list_concat(w[1:a], list_transform(range(n - a), lambda i: w[a + i % p + 1])) AS x FROM p),
grams AS (SELECT r, n, i, md5(array_to_string(x[i + 1:i + 5], ' ')) AS gram FROM (SELECT r, n, x, unnest(range(n - 4)) AS i FROM x WHERE n > 4)),
again AS (SELECT r, n, i, gram FROM grams QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
pairs AS (SELECT l.r, l.i, m.i - l.i AS q FROM again l JOIN again m ON l.r = m.r AND l.gram = m.gram AND m.i > l.i AND 4 * (m.i - l.i) <= l.n),
parts AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM pairs),
long AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS len FROM parts GROUP BY r, q, part),
runs AS (SELECT r, s, len, min(q) AS q FROM long WHERE len >= greatest(6, 4 * q) GROUP BY r, s, len),
best AS (SELECT r, count(*) AS n_runs, arg_min([s, len, q], [-len, s, q]) AS b, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS sha FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT o.r, string_agg(word, ' ' ORDER BY o.i) AS body FROM (SELECT r, unnest(x) AS word, unnest(range(n)) AS i FROM x WHERE r IN (SELECT r FROM best)) o ANTI JOIN gone ON gone.r = o.r AND gone.i = o.i GROUP BY o.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b[1] AS BIGINT) AS start, CAST(b[2] AS BIGINT) AS length, CAST(b[3] AS BIGINT) AS period,
       CAST(1000 * b[2] // b[3] AS BIGINT) AS exponent_milli, coalesce(sha, sha256('')) AS runs_sha256, sha256(CASE WHEN n_runs IS NULL THEN array_to_string(x, ' ') ELSE coalesce(body, '') END) AS collapsed_sha256
FROM x LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
