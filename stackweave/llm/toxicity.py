"""Toxicity: a lexicon trie intersected with a Levenshtein automaton finds terms and misspellings; context weighs them.

Terms are stems: a word counts as a hit if it begins with a stem, or, for stems of five characters and more, with
something one edit away. Stems beyond the given ones are learned from labelled rows: word beginnings whose documents
are toxic far more often than chance allows (`certainty` nats over all beginnings looked at). The trie of all stems and
the automaton of one edit are intersected once, on the driver, into a table of states over byte classes; tasks
run all words of a run of texts through it at the same time, and nearly all words die within a few bytes.

Each hit carries how telling its stem and its edit distance are, and what a window of `reach` words around it says:
quotation marks and verbs of saying speak for quotation, words of address for abuse. A logistic model over these
turns hits into a score. It is fitted on labelled rows that the caller hands in; at most about `sample` of them, chosen
by hash of the id, are used. Scoring looks at texts only: never at labels, languages, sources or ids.

Null and empty texts have no hits and get the score of a text without hits. With no labelled rows the given terms and
fixed weights are used. Repeated rows and null ids get one result row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackweave.llm import words as W
from stackweave.llm.common import pieces, stored

TERMS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "imbecile", "dumbass")
SAYING = ("said", "says", "called", "wrote", "quote", "quoted", "word", "term", "called")
ADDRESS = ("you", "your", "youre", "u", "are", "du", "tu", "vous", "bist")
FUZZY_FROM = 5
_FEATURES = 6


def trie_automaton(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes, transitions, and per state the term reached (-1: none) and its distance.

    A state is the set of (trie node, edits) that some reading of the bytes so far allows; edits stay at most one.
    State 0 is dead, state 1 the start.
    """
    children: list[dict[int, int]] = [{}]
    terminal: dict[int, int] = {}
    for k, term in enumerate(terms):
        node = 0
        for b in term.encode():
            if b not in children[node]:
                children.append({})
                children[node][b] = len(children) - 1
            node = children[node][b]
        terminal.setdefault(node, k)
    letters = sorted({b for c in children for b in c})
    classes = np.zeros(256, np.uint8)
    for i, b in enumerate(letters):
        classes[b] = i + 1

    def close(states: set[tuple[int, int]]) -> frozenset:
        return frozenset(states | {(child, 1) for node, e in states if e == 0 for child in children[node].values()})

    def step(states: frozenset, letter: int | None) -> frozenset:
        out = set()
        for node, e in states:
            if letter in children[node]:
                out.add((children[node][letter], e))
            if e == 0:
                out.add((node, 1))  # inserted
                out.update((child, 1) for child in children[node].values())  # replaced
        return close({(n, e) for n, e in out if (n, 0) not in out or e == 0})

    def reached(states: frozenset) -> tuple[int, int]:
        best = min(((e, terminal[n]) for n, e in states if n in terminal and (e == 0 or len(terms[terminal[n]]) >= FUZZY_FROM)), default=(9, -1))
        return best[1], best[0]

    start = close({(0, 0)})
    number, todo, table, accept = {frozenset(): 0, start: 1}, [start], {}, {0: (-1, 9), 1: (-1, 9)}
    while todo:
        states = todo.pop()
        row = []
        for letter in (None, *letters):
            after = step(states, letter)
            if after not in number:
                number[after] = len(number)
                accept[number[after]] = reached(after)
                todo.append(after)
            row.append(number[after])
        table[number[states]] = row
    moves = np.zeros((len(number), len(letters) + 1), np.int32)
    for s, row in table.items():
        moves[s] = row
    return classes, moves, np.array([accept[s][0] for s in range(len(number))], np.int32), np.array([accept[s][1] for s in range(len(number))], np.int8)


def find_hits(words: W.Words, automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words, their terms and edit distances (the least distance over all beginnings of a word)."""
    classes, moves, term, distance = automaton
    if not len(words.starts) or not len(term):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)
    at, place, end = np.arange(len(words.starts)), words.starts.copy(), words.ends
    lowered = W._LOWER
    state = np.ones(len(at), np.int32)
    found: dict[int, tuple[int, int]] = {}
    while len(at):
        state = moves[state, classes[lowered[words.data[place]]]]
        hit = np.flatnonzero(term[state] >= 0)
        for w, t, d in zip(at[hit].tolist(), term[state[hit]].tolist(), distance[state[hit]].tolist()):
            if w not in found or d < found[w][1]:
                found[w] = (t, d)
        place = place + 1
        go = np.flatnonzero((state > 0) & (place < end) & (distance[state] > 0))
        at, place, end, state = at[go], place[go], end[go], state[go]
    order = sorted(found)
    return np.array(order, np.int64), np.array([found[w][0] for w in order], np.int32), np.array([found[w][1] for w in order], np.int8)


@dataclass
class Model:
    """Terms, how telling each (term, distance) is, and the weights of the document features; a few kilobytes."""

    terms: list[str]
    telling: dict[tuple[int, int], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-2.5, 1.5, 1.0, 0.5, -0.5, 0.5, 0.3]))
    reach: int = 5


_QUOTES = np.zeros(256, bool)
_QUOTES[[34, 0xAB, 0xBB]] = True
_CONTEXT = W.split(pa.array([" ".join((*SAYING, *ADDRESS))], pa.large_string()), W.PUNCTUATION, True).hashes
_SAYS, _ADDRESS = set(_CONTEXT[:len(SAYING)].tolist()), set(_CONTEXT[len(SAYING):].tolist())


def _hits_of(words: W.Words, automaton, reach: int) -> dict[int, list[tuple[int, int, bool, bool]]]:
    """Per row: (term, distance, quoted, addressed) of its hits."""
    out: dict[int, list[tuple[int, int, bool, bool]]] = {}
    at, terms, distances = find_hits(words, automaton)
    rows = np.searchsorted(words.first, at, "right") - 1
    for w, t, d, row in zip(at.tolist(), terms.tolist(), distances.tolist(), rows.tolist()):
        low, high = max(w - reach, int(words.first[row])), min(w + reach + 1, int(words.first[row + 1]))
        near = set(words.hashes[low:high].tolist())
        before = _QUOTES[words.data[words.starts[low]:words.starts[w]]].sum()
        after = _QUOTES[words.data[words.ends[w]:words.ends[high - 1]]].sum()
        quoted = bool((before % 2 == 1 and after > 0) or near & _SAYS)
        out.setdefault(row, []).append((t, d, quoted, bool(near & _ADDRESS)))
    return out


def _features(hits: list[tuple[int, int, bool, bool]], model: Model) -> list[float]:
    """Largest and summed evidence, distinct telling terms, quoted and addressed evidence, exact hits."""
    if not hits:
        return [0.0] * _FEATURES
    value = [max(model.telling.get((t, d), 1.0 if d == 0 else 0.2), 0.0) for t, d, _, _ in hits]
    total = sum(value)
    return [max(value), math.log1p(total), len({t for (t, _, _, _), v in zip(hits, value) if v > 1}),
            sum(v for v, h in zip(value, hits) if h[2]) / (1 + total), sum(v for v, h in zip(value, hits) if h[3]) / (1 + total),
            math.log1p(sum(h[1] == 0 for h in hits))]


def learn_terms(labelled: DataFrame, given: tuple[str, ...] = TERMS, shortest: int = 3, longest: int = 10, certainty: float = 18.0) -> list[str]:
    """Stems from (text, toxic) rows, most telling first, before the given ones; as many as are certain.

    A stem is a word beginning of `shortest` to `longest` code points, so longer words are known by their beginning. Its
    three toxic rows and its certainty bound the number of stems by the size of the labelled sample. Of a chain of beginnings the longest that keeps 97 % of the toxic documents of the shortest telling one is the stem.
    """
    base = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    if not base["t"] or base["t"] == base["n"]:
        return list(given)
    p = base["t"] / base["n"]
    words = r"array_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0))"
    heads = f"array_distinct(flatten(transform(filter({words}, w -> length(w) >= {shortest}), w -> transform(sequence({shortest}, least(length(w), {longest})), k -> left(w, k)))))"
    counted = labelled.select(F.explode(F.expr(heads)).alias("head"), "toxic").groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    q = F.least(F.col("t") / F.col("n"), F.lit(1 - 1e-9))
    gain = F.col("n") * (q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p)))
    found = counted.filter((F.col("t") >= 3) & (F.col("t") >= 0.7 * F.col("n"))).withColumn("gain", gain).filter(F.col("gain") >= certainty)
    rows = found.orderBy(F.desc("gain"), "head").collect()  # bounded by the sample
    toxic = {r["head"]: r["t"] for r in rows}
    roots = {head: next((head[:k] for k in range(shortest, len(head)) if head[:k] in toxic), head) for head in toxic}
    longest_of: dict[str, str] = {}
    for head, root in roots.items():
        if toxic[head] >= 0.97 * toxic[root]:
            longest_of[root] = max(longest_of.get(root, head), head, key=lambda h: (len(h), h))
    stems: dict[str, None] = {}  # in order
    for root in roots.values():
        stem = longest_of[root]
        if not any(stem[:k] in stems for k in range(shortest, len(stem) + 1)):
            stems[stem] = None
    stems = list(stems)
    return stems + [g for g in given if not any(g.startswith(s) for s in stems)]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, given: tuple[str, ...] = TERMS, reach: int = 5, sample: int = 20_000) -> Model:
    """A model from rows (doc_id, text, toxic 0/1); about `sample` of them are used, by hash of doc_id."""
    labelled = labelled.filter("toxic IS NOT NULL").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    count = labelled.select("toxic").count()
    if count > sample:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int((1 << 20) * sample / count))
    labelled = stored(labelled)
    terms = learn_terms(labelled, given)
    automaton = trie_automaton(terms)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            found = _hits_of(W.split(texts, W.PUNCTUATION, True), automaton, reach)
            flat = [[v for h in found.get(i, ()) for v in (h[0], h[1], int(h[2]), int(h[3]))] for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(flat, pa.list_(pa.int32()))], ["toxic", "hits"])

    rows = labelled.mapInArrow(hits, "toxic int, hits array<int>").collect()  # at most about `sample` rows
    y = np.array([r["toxic"] for r in rows], float)
    model = Model(terms, reach=reach)
    if not len(y) or y.min() == y.max():
        return model
    seen = [[tuple(r["hits"][i:i + 2]) + tuple(map(bool, r["hits"][i + 2:i + 4])) for i in range(0, len(r["hits"]), 4)] for r in rows]
    totals: dict[tuple[int, int], list[float]] = {}
    for hs, label in zip(seen, y):
        for key in {h[:2] for h in hs}:
            totals.setdefault(key, [0.0, 0.0])[int(label)] += 1
    p = y.mean()
    model.telling = {k: math.log((t + p) / (c + 1 - p) * (1 - p) / p) for k, (c, t) in totals.items()}
    model.weights = _fit(np.array([_features(h, model) for h in seen]), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `__score`, 0 to 1."""
    automaton = docs.sparkSession.sparkContext.broadcast(trie_automaton(model.terms))  # bounded by the number of terms

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            found = _hits_of(W.split(texts, W.PUNCTUATION, True), automaton.value, model.reach)
            x = np.array([_features(found.get(i, []), model) for i in range(len(batch))]).reshape(len(batch), _FEATURES)
            z = model.weights[0] + x @ model.weights[1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*batch.schema.names, "__score"])

    from pyspark.sql.types import DoubleType, StructType
    return docs.mapInArrow(judge, StructType([*docs.schema.fields]).add("__score", DoubleType()))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn from: those whose crc32 of the id as text, modulo 5, is not 0; one label for each id."""
    marks = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(marks, "doc_id")


def toxicity_report(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row (a null id is not held out)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` with a score below `threshold`."""
    return score(docs, model).filter(F.col("__score") < threshold).drop("__score")


def op7_toxicity(spark, folder):
    from stackweave.llm.common import read
    docs = read(spark, folder, "documents")
    return toxicity_report(docs, fit(labelled_rows(docs, read(spark, folder, "labels"))))
