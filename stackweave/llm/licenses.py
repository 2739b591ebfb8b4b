"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words of a text after lower-casing A-Z, wherever its lines break. Windows of one
template are as long as the template plus the words a match may lack, and start at every word. A template matches a
window that holds at least `threshold` of its distinct words. Words of templates are counted over all documents and
ordered by that frequency, rarest first, with the same order on both sides:

* prefix: a match must hold one of the first |T| - ceil(threshold |T|) + 1 template words, so only those are looked up;
* length: a text of fewer than ceil(threshold |T|) words cannot match;
* position: so many template words must stand within a window's length of the word looked up.

Templates that differ in a word or two are rivals: the words of one would match the other. A match must then hold the
words that no template of another label has ("affero", "bsd"), and of overlapping windows of rivals one stays: first one
with such words, then the greater containment, then more words; ties stay. Of one template's overlapping windows the
fullest stays, then the shortest, then the first.

Survivors are verified on the words. The templates are a parameter of fixed size, so the join needs no shuffle:
one job counts words, one scans. Besides, base phrases are found wherever their words stand consecutively.

Null texts are empty: no words, no labels, score 0. Repeated rows and null ids give one result row each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackweave.llm import words as W
from stackweave.llm.common import pieces

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices in common use; label and words.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 2 1"),
    ("agpl", "this program is licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("epl", "this program is made available under the terms of the eclipse public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "this work is dedicated to the public domain under the cc0 universal dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hash(words: list[str]) -> np.ndarray:
    return W.split(pa.array([" ".join(words)], pa.large_string()), W.PUNCTUATION, True).hashes


class _Lookup:
    """Word hash to index in a fixed list of words, for whole arrays; -1 elsewhere."""

    def __init__(self, words: list[str]):
        hashes = _hash(words)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.map = np.zeros(1 << 16, bool)
        self.map[hashes >> W.U(48)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known words, and which word each is."""
        places = np.flatnonzero(self.map[hashes >> W.U(48)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[places]), len(self.sorted) - 1)
        good = self.sorted[at] == hashes[places]
        return places[good], self.order[at[good]]


def template_word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How many documents hold each of the given words; a task sends one row per word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, totals = _Lookup(words), np.zeros(len(words), np.int64)
        for _, texts in pieces(batches):
            found = W.split(texts, W.PUNCTUATION, True)
            places, known = lookup.find(found.hashes)
            rows = np.searchsorted(found.first, places, "right") - 1
            totals += np.bincount(np.unique(rows * len(words) + known) % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words), dtype=np.int32)), pa.array(totals)], ["word", "docs"])

    rows = docs.select("text").mapInArrow(count, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    return {words[r["word"]]: r["docs"] for r in rows}


def _rivalry(templates: list[tuple[str, str]], percent: int) -> tuple[list[list[int]], list[set[str]]]:
    """For each template its rivals, and the words of its own that a match must hold if it has any.

    Two templates of different labels are rivals if the full words of one are enough to match the other. A template's own
    words are those that no template of another label holds.
    """
    sets = [set(text.split()) for _, text in templates]
    rivals: list[list[int]] = [[] for _ in templates]
    required: list[set[str]] = [set() for _ in templates]
    for k, (label, _) in enumerate(templates):
        others = [j for j, (other, _) in enumerate(templates) if other != label]
        for j in others:
            both = 100 * len(sets[j] & sets[k])
            if both >= percent * min(len(sets[j]), len(sets[k])):
                rivals[k].append(j)
            if both >= percent * len(sets[k]):
                required[k] = sets[k].difference(*(sets[i] for i in others))
    return rivals, required


class _Index:
    """Templates in global word order, indexed by their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], percent: int):
        self.vocabulary = sorted({w for _, text in templates for w in text.split()}, key=lambda w: (counts.get(w, 0), w))
        self.lookup = _Lookup(self.vocabulary)
        rank = {w: i for i, w in enumerate(self.vocabulary)}
        self.templates = [(label, sorted({rank[w] for w in text.split()})) for label, text in templates]
        self.sets = [set(t) for _, t in self.templates]
        self.need = [-(-percent * len(t) // 100) for _, t in self.templates]
        self.length = [len(text.split()) + len(t) - n for (_, text), (_, t), n in zip(templates, self.templates, self.need)]
        self.rivals, self.required = _rivalry(templates, percent)
        self.required = [{rank[w] for w in words} for words in self.required]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (_, ranks) in enumerate(self.templates):
            for position, r in enumerate(ranks[:len(ranks) - self.need[k] + 1]):
                self.prefix.setdefault(r, []).append((k, position))
        self.starts = np.zeros(len(self.vocabulary), bool)
        self.starts[list(self.prefix)] = True

    def _windows(self, at: list[int], ranks: list[int], size: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, words held, first word, end) of every window that holds enough of a template and all that it must."""
        seen = set()
        for here, r in zip(at, ranks):
            for k, _ in self.prefix.get(r, ()):
                template, need, length = self.sets[k], self.need[k], self.length[k]
                low, high = bisect_left(at, here - length + 1), bisect_right(at, here + length - 1)
                if size < need or high - low < need:
                    continue
                for first in range(low, bisect_right(at, here)):
                    if ranks[first] not in template or (k, first) in seen:
                        continue
                    seen.add((k, first))
                    held, end = set(), 0
                    for i in range(first, bisect_left(at, at[first] + length)):
                        if ranks[i] in template and ranks[i] not in held:
                            held.add(ranks[i])
                            end = at[i] + 1
                    if len(held) >= need and self.required[k] <= held:
                        yield k, len(held), at[first], end

    def match(self, at: list[int], ranks: list[int], size: int) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of the windows that win, in a text of `size` words that holds these
        template words at these places, ascending."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, held, first, end in self._windows(at, ranks, size):
            found.setdefault(k, []).append((held, first, end))
        for k, mine in found.items():  # of one template's overlapping windows the fullest, then shortest, then first
            order = sorted(mine, key=lambda w: w[1])
            longest = max(w[2] - w[1] for w in mine)
            starts = [w[1] for w in order]
            found[k] = [(h, a, e) for h, a, e in order if not any(
                x < e and a < y and (-g, y - x, x) < (-h, e - a, a) for g, x, y in order[bisect_left(starts, a - longest):bisect_left(starts, e)])]

        def rank(k: int, held: int) -> tuple[bool, float, int]:
            return bool(self.required[k]), held / len(self.sets[k]), held

        return [(k, a, e, h / len(self.sets[k])) for k in sorted(found) for h, a, e in found[k] if not any(
            x < e and a < y and rank(j, g) > rank(k, h) for j in self.rivals[k] for g, x, y in found.get(j, ()))]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    `percent` is the containment threshold. `score` is 1 with a base phrase, else the largest containment.
    `matches` lists every matching window: template, first word, number of words, containment.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = template_word_counts(docs, sorted({w for _, text in templates for w in text.split()}))
    split_phrases = [(p.split(), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates, counts, percent)
        heads = [(_hash(p), [w.encode() for w in p], label) for p, label in split_phrases]
        for batch, texts in pieces(batches):
            words = W.split(texts, W.PUNCTUATION, True)
            n = len(batch)
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            matches: list[list[dict]] = [[] for _ in range(n)]
            for hashes, plain, label in heads:
                at = np.flatnonzero(words.hashes == hashes[0])
                for a in at.tolist():
                    row = int(np.searchsorted(words.first, a, "right")) - 1
                    if a + len(plain) <= words.first[row + 1] and all(words.text(a + i, True) == p for i, p in enumerate(plain)):
                        base[row].append((a - int(words.first[row]), label))
            places, known = index.lookup.find(words.hashes)
            row = np.searchsorted(words.first, places, "right") - 1
            for r in np.unique(row[index.starts[known]]).tolist():
                mine = slice(*np.searchsorted(row, [r, r + 1]))
                for k, first, end, share in index.match((places[mine] - words.first[r]).tolist(), known[mine].tolist(), int(words.first[r + 1] - words.first[r])):
                    matches[r].append({"label": index.templates[k][0], "first_word": first, "n_words": end - first, "containment": share})
            found_base = [sorted({label for _, label in b}) for b in base]
            labels = [",".join(sorted({*f, *(m["label"] for m in ms)})) for f, ms in zip(found_base, matches)]
            starts = [[p for p, _ in b] for b in base]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), pa.array([len(b) for b in base], pa.int64()),
                pa.array([min(s, default=None) for s in starts], pa.int64()), pa.array([max(s, default=None) for s in starts], pa.int64()),
                pa.array([",".join(f) for f in found_base], pa.string()), pa.array(labels, pa.string()),
                pa.array([1.0 if b else max((m["containment"] for m in ms), default=0.0) for b, ms in zip(base, matches)], pa.float64()),
                pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                                 "matches array<struct<label:string,first_word:bigint,n_words:bigint,containment:double>>")


def op1_license_scans(spark, folder):
    from stackweave.llm.common import read
    return scan_licenses(read(spark, folder, "documents")).drop("matches")


def _sql_template(k: int, label: str, text: str, required: set[str]) -> str:
    words = list(dict.fromkeys(text.split()))
    need = -(-80 * len(words) // 100)
    return f"({k}, '{label}', {words!r}, {need}, {len(text.split()) + len(words) - need}, {sorted(required)!r}::VARCHAR[])"


_RIVALS, _REQUIRED = _rivalry(TEMPLATES, 80)
_SQL_TEMPLATES = ", ".join(_sql_template(k, *t, _REQUIRED[k]) for k, t in enumerate(TEMPLATES))
_SQL_RIVALS = ", ".join(f"({k}, {j})" for k, js in enumerate(_RIVALS) for j in js)
SQL = r"""
WITH d AS (SELECT doc_id, r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM (SELECT *, row_number() OVER () AS r FROM documents)),
w AS (SELECT doc_id, r, body, regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
phrases(phrase, label) AS (VALUES """ + ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items()) + r"""),
base AS (SELECT r, i - 1 AS place, label FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w) JOIN phrases ON words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase),
based AS (SELECT r, count(*) AS n, min(place) AS low, max(place) AS high FROM base GROUP BY r),
templates(k, label, words, need, span, required) AS (VALUES """ + _SQL_TEMPLATES + r"""),
rivals(k, j) AS (VALUES """ + _SQL_RIVALS + r"""),
vocabulary AS (SELECT k, unnest(words) AS word FROM templates),
spots AS (SELECT r, i - 1 AS place, words[i] AS word FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w) WHERE words[i] IN (SELECT word FROM vocabulary)),
tied AS (SELECT r, k, place, word FROM spots JOIN vocabulary USING (word)),
likely AS (SELECT r, k, need, span, required FROM tied JOIN templates USING (k) GROUP BY ALL HAVING count(DISTINCT tied.word) >= need),
firsts AS (SELECT r, k, a.place AS low, b.word, min(b.place) AS place, any_value(need) AS need, any_value(required) AS required
           FROM likely JOIN tied a USING (r, k) JOIN tied b USING (r, k) WHERE b.place >= a.place AND b.place < a.place + span GROUP BY r, k, a.place, b.word),
full_windows AS (SELECT r, k, low, count(*) AS held, max(place) + 1 AS high FROM firsts GROUP BY r, k, low HAVING count(*) >= any_value(need) AND list_has_all(list(word), any_value(required))),
peaks AS (SELECT p.*, len(required) > 0 AS own, held / len(words) AS share FROM full_windows p JOIN templates USING (k) WHERE NOT EXISTS (
          SELECT 1 FROM full_windows o WHERE o.r = p.r AND o.k = p.k AND o.low < p.high AND p.low < o.high AND (-o.held, o.high - o.low, o.low) < (-p.held, p.high - p.low, p.low))),
matched AS (SELECT r, label, share FROM peaks p JOIN templates USING (k) WHERE NOT EXISTS (
            SELECT 1 FROM peaks o JOIN rivals v ON v.k = p.k AND v.j = o.k WHERE o.r = p.r AND o.low < p.high AND p.low < o.high AND (o.own, o.share, o.held) > (p.own, p.share, p.held))),
marked AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM matched) GROUP BY r),
plain AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT r, label FROM base) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM matched GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(based.n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
       coalesce(plain.labels, '') AS base_labels, coalesce(marked.labels, '') AS labels, CAST(CASE WHEN based.n > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN based USING (r) LEFT JOIN plain USING (r) LEFT JOIN marked USING (r) LEFT JOIN best USING (r)
"""
