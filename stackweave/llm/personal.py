"""Personal data: base patterns, and identifiers discovered from the contexts that base matches share.

Seeds are base matches and values that show by their form what they are: long hexadecimal strings of digits and letters,
mixed strings of high entropy, account numbers whose checksum holds (`shaped`). The latter are spans of kind `id`.

Bootstrapping: every seed and every other identifier-like token (five digits or
more, outside seeds) is an instance with lexical patterns: the word before, the two words before, the word
after. Instances and patterns form a bipartite graph over all documents. Spark scores it in rounds: a pattern's
confidence is the summed score of its distinct instances over their number plus one (patterns of fewer than
`support` distinct known instances count nothing); an instance's score is one minus the product of what its patterns
leave in doubt. Instances that reach `accept` are known from the next round on. They become
spans of kind `id` if they reach it once more by the stricter confidence below, so that stop words, whose places hold
all sorts of tokens, speak for nothing.

Values of any form are taken from slots. For them a pattern's confidence is stricter: the scores of its known instances
over the number of all distinct tokens in its places, identifier-like or not. In the places of patterns that reach
`trust` so, a slot is the run of tokens from an opening to a closing pattern in one clause (no token before the last
ends in punctuation or a line, none after the first is opened itself); with one side marked, the neighbouring tokens
with digits; else one token. Such values are spans in their slots only, as a short value means something else
elsewhere. Both kinds are scored until a round accepts no new value and moves no score by 0.001.

Neighbouring words are looked for within 200 code points of an instance; a longer word is named by the part within.

Patterns with `support` known instances are collected to the driver and sent to the tasks. A task holds their distinct
tokens only while these are few enough for `trust`, so at most in proportion to the known instances.

Offsets are code points, ends exclusive. Null texts are empty: no spans. Repeated rows, and rows with null ids, get
the result of their text. Joins go by document and text hash; hot patterns are reduced by grouped sums before a join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stackweave.llm.common import pieces, row_hash, stored

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can start at the head of a run of digits only
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*")
_ANY = re.compile(r"\S+")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_MIXED = re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{24,}(?![0-9A-Za-z_-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_EDGE = " \t\n\r.,;:!?|()[]{}<>\"'"
_BEFORE, _AFTER = re.compile(r"(\S+)\s+(\S+)\s*$|(\S+)\s*$"), re.compile(r"\s*(\S+)")
_REACH = 200  # code points of context beside an instance in which its neighbouring words are looked for


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: a local part reaches back from its @ to the first other character or the last match."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def _entropy(value: str) -> float:
    """Bits per character by the value's own letter counts."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def shaped(text: str) -> list[tuple[int, int]]:
    """Ascending, non-overlapping spans whose form alone says secret or account: hexadecimal of 32 and more with digits and
    letters; 24 and more letters and digits of both cases, four digits at least and 3.5 bits a character; account numbers of
    two letters, two check digits and 8 to 31 more whose remainder modulo 97 is 1."""
    found = [m.span() for m in _HEX.finditer(text) if not m.group().isdigit() and any(c.isdigit() for c in m.group())]
    for m in _MIXED.finditer(text):
        v = m.group()
        if v != v.lower() and v != v.upper() and sum(c.isdigit() for c in v) >= 4 and _entropy(v) >= 3.5:
            found.append(m.span())
    for m in _ACCOUNT.finditer(text):
        v = m.group().replace(" ", "")
        if int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1:
            found.append(m.span())
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _forms(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Shaped spans outside base matches."""
    return [(a, b) for a, b in shaped(text) if not any(x <= a and b <= y for _, x, y in base)]


def _patterns(text: str, start: int, end: int) -> list[str]:
    m = _BEFORE.search(text[max(0, start - _REACH):start])
    words = [w for w in m.groups() if w] if m else []
    n = _AFTER.match(text[end:end + _REACH])
    out = []
    if words and (last := words[-1].lower().strip(_EDGE)):
        out.append(f"before {last}")
        if len(words) == 2:
            out.append(f"before {words[0].lower().strip(_EDGE)} {last}")
    if n and (after := n.group(1).lower().strip(_EDGE)):
        out.append(f"after {after}")
    return out


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, bool, bool, int, int, list[str]]]:
    """(value, is seed, is shaped, start, end, patterns) of base matches, shaped values and identifier-like tokens."""
    forms = _forms(text, base)
    out = [(text[a:b], True, False, a, b, _patterns(text, a, b)) for _, a, b in base]
    out += [(text[a:b], True, True, a, b, _patterns(text, a, b)) for a, b in forms]
    taken = sorted([(a, b) for _, a, b in base] + forms)
    for m in _TOKEN.finditer(text):
        token = m.group()
        value = token.strip(_EDGE)
        start = m.start() + len(token) - len(token.lstrip(_EDGE))
        if sum("0" <= c <= "9" for c in value) >= 5 and not any(a < start + len(value) and start < b for a, b in taken):
            out.append((value, False, False, start, start + len(value), _patterns(text, start, start + len(value))))
    return out


_FOUND = pa.list_(pa.struct([("value", pa.string()), ("seed", pa.bool_()), ("shaped", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("patterns", pa.list_(pa.string()))]))


_SLOTS = pa.list_(pa.struct([("value", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("patterns", pa.list_(pa.string()))]))


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, found) of every document row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            base, found = [], []
            for text in texts.to_pylist():
                spans = base_spans(text)
                base.append([f"{k}:{a}:{b}" for k, a, b in spans])
                found.append([dict(zip(("value", "seed", "shaped", "start", "stop", "patterns"), x)) for x in instances(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(base, pa.list_(pa.string())), pa.array(found, _FOUND)],
                                             ["doc_id", "row", "base", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_hash(F.col("text")).alias("row")).mapInArrow(
        find, f"doc_id {kind}, row long, base array<string>, found array<struct<value:string,seed:boolean,shaped:boolean,start:bigint,stop:bigint,patterns:array<string>>>")


def _marks(low: list[str], i: int) -> tuple[list[str], list[str]]:
    """Patterns that open and that close at token i of the lower-cased, stripped tokens of a text."""
    opens = []
    if i and (last := low[i - 1]):
        opens.append(f"before {last}")
        if i > 1:
            opens.append(f"before {low[i - 2]} {last}")
    return opens, [f"after {low[i + 1]}"] if i + 1 < len(low) and low[i + 1] else []


def slots(text: str, trusted: set[str]) -> list[tuple[str, int, int, list[str]]]:
    """(value, start, end, patterns) of the slots that `trusted` patterns mark outside seeds."""
    low = [w.strip(_EDGE) for w in text.lower().split()]
    marks = [tuple(any(p in trusted for p in side) for side in _marks(low, i)) for i in range(len(low))]
    if not any(a or b for a, b in marks):
        return []
    tokens, spans = [], []
    for m in _ANY.finditer(text):
        left = len(m.group()) - len(m.group().lstrip(_EDGE))
        tokens.append((m.start() + left, max(m.start() + left, m.start() + len(m.group().rstrip(_EDGE))), m.end()))
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base] + _forms(text, base)
    ends = [i + 1 == len(tokens) or tokens[i][1] < tokens[i][2] or "\n" in text[tokens[i][2]:tokens[i + 1][0]] or "\r" in text[tokens[i][2]:tokens[i + 1][0]] for i in range(len(tokens))]
    digits = [any("0" <= c <= "9" for c in text[a:b]) for a, b, _ in tokens]
    closed = set()
    for i, (opening, _) in enumerate(marks):
        if opening:
            j = i
            while not marks[j][1] and not ends[j] and not marks[j + 1][0]:
                j += 1
            if marks[j][1]:
                closed.add(j)
            else:
                j = i
                while digits[j] and not ends[j] and digits[j + 1]:
                    j += 1
            spans.append((i, j))
    for j, (_, closing) in enumerate(marks):
        if closing and j not in closed:
            i = j
            while digits[i] and i and not ends[i - 1] and digits[i - 1]:
                i -= 1
            spans.append((i, j))
    out = []
    for i, j in sorted(set(spans)):
        a, b = tokens[i][0], tokens[j][1]
        if a < b and not any(x < b and a < y for x, y in taken):
            out.append((text[a:b], a, b, _patterns(text, a, b)))
    return out


def _strict(docs: DataFrame, edges: DataFrame, known: DataFrame, support: int, trust: float) -> dict[str, float]:
    """Confidence of patterns that reach `trust` among all tokens in their places, whatever these look like."""
    mine = edges.join(known, "value")
    counts = mine.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")).filter(F.col("n") >= support)
    table = {r["pattern"]: (r["n"], r["total"]) for r in counts.collect()}
    if not table:
        return {}
    context = docs.sparkSession.sparkContext
    limits = context.broadcast({p: n + int(n / trust) for p, (n, _) in table.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, dead = dict(limits.value), []
        held: dict[str, set[str]] = {}
        last = Counter(p.rsplit(" ", 1)[1] for p in open_ if p.startswith("before "))
        next_ = {p[6:] for p in open_ if p.startswith("after ")}

        def meet(pattern: str, value: str) -> None:
            if pattern in open_ and (value := value.strip(_EDGE)):
                seen = held.setdefault(pattern, set())
                seen.add(value)
                if len(seen) > open_[pattern]:
                    dead.append(pattern)
                    del open_[pattern], held[pattern]
                    word = pattern.rsplit(" ", 1)[1]
                    if pattern.startswith("after "):
                        next_.discard(word)
                    elif last[word] == 1:
                        del last[word]
                    else:
                        last[word] -= 1

        for _, texts in pieces(batches):
            for text in texts.to_pylist():
                values, low = text.split(), [w.strip(_EDGE) for w in text.lower().split()]
                for i, word in enumerate(low):
                    if word in last and i + 1 < len(low):
                        meet(f"before {word}", values[i + 1])
                        if i:
                            meet(f"before {low[i - 1]} {word}", values[i + 1])
                    if i and word in next_:
                        meet(f"after {word}", values[i - 1])
        pairs = [(p, v) for p, vs in held.items() for v in vs] + [(p, None) for p in dead]
        for k in range(0, len(pairs), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*pairs[k:k + 10_000])], ["pattern", "token"])

    tokens = stored(docs.select("text").mapInArrow(count, "pattern string, token string").distinct())
    words = F.split(F.col("value"), r"\s+")
    edge = mine.select("pattern", F.when(F.col("pattern").startswith("before "), F.element_at(words, 1)).otherwise(F.element_at(words, -1)).alias("token"))
    edge = edge.select("pattern", F.btrim("token", F.lit(_EDGE)).alias("token")).distinct()
    other = tokens.join(edge, ["pattern", "token"], "left_anti").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("token").isNull()).alias("dead"))
    others = {r["pattern"]: (r["n"], r["dead"]) for r in other.collect()}
    limits.destroy()
    out = {}
    for p, (n, total) in table.items():
        more, dead = others.get(p, (0, False))
        if not dead and (share := total / (n + more + 1)) >= trust:
            out[p] = share
    return out


def discover(found: DataFrame, docs: DataFrame, rounds: int | None = None, support: int = 3, trust: float = 0.5, accept: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """((value, score) of accepted identifier-like tokens, (doc_id, row, start, stop) of accepted slots).

    `found` has value, seed, patterns; `docs` has doc_id, text, row. Patterns need `support` distinct known instances and
    a confidence of `trust` to speak for an instance. `rounds` ends the rounds early.
    """
    spark = docs.sparkSession

    def doubt():
        return (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score")

    def extract_slots(trusted: dict[str, float]) -> DataFrame:
        patterns = spark.sparkContext.broadcast(set(trusted))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches):
                found = [[dict(zip(("value", "start", "stop", "patterns"), x)) for x in slots(text, patterns.value)] for text in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found, _SLOTS)], ["doc_id", "row", "found"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return stored(docs.select("doc_id", "text", "row").mapInArrow(find, f"doc_id {kind}, row long, found array<struct<value:string,start:bigint,stop:bigint,patterns:array<string>>>").select(
            "doc_id", "row", F.inline("found")))

    base = stored(found.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.max("seed").alias("seed")))
    tokens = stored(found.groupBy("value").agg(F.max("seed").alias("seed")))
    nothing = spark.createDataFrame([], "value string, score double")
    scores = known = stored(tokens.filter("seed").select("value", F.lit(1.0).alias("score")))
    edges, size, done, marked, accepted_slots, sure = base.select("value", "pattern"), known.count(), 0, None, nothing, nothing
    while rounds is None or done < rounds:
        done += 1
        support_of = edges.join(known.select("value", F.lit(1).alias("known")), "value", "left").join(scores, "value", "left").groupBy("pattern").agg(
            (F.sum(F.coalesce("score", F.lit(0.0))) / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count("known").alias("support"))
        confidence = support_of.filter((F.col("support") >= support) & (F.col("confidence") >= trust)).select("pattern", "confidence")
        soft = base.join(confidence, "pattern").groupBy("value").agg(doubt())
        before = scores
        scores = stored(soft.unionByName(known).groupBy("value").agg(F.max("score").alias("score")))
        moved = scores.withColumnRenamed("score", "now").join(before, "value", "left").agg(F.max(F.col("now") - F.coalesce("score", F.lit(0.0)))).first()[0] or 0.0
        grown = stored(scores.filter(F.col("score") >= accept))
        total = grown.count()
        if total == size and moved < 0.001 or rounds is not None and done == rounds:
            strict = _strict(docs, edges, grown, support, trust)
            if strict:
                marked = extract_slots(strict)
                table = spark.createDataFrame(list(strict.items()), "pattern string, confidence double")
                sure = base.join(table, "pattern").groupBy("value").agg(doubt()).filter(F.col("score") >= accept)
                spans = marked.select("value", F.explode("patterns").alias("pattern")).distinct()
                accepted_slots = stored(spans.join(table, "pattern").groupBy("value").agg(doubt()).filter(F.col("score") >= accept).unionByName(accepted_slots).groupBy("value").agg(F.max("score").alias("score")))
                edges = stored(edges.unionByName(spans.join(accepted_slots, "value", "left_semi")).distinct())
                grown = stored(grown.unionByName(accepted_slots).groupBy("value").agg(F.max("score").alias("score")))
                total = grown.count()
            if total == size:
                known = grown
                break
            scores = stored(scores.unionByName(grown).groupBy("value").agg(F.max("score").alias("score")))
        known, size = grown, total
    ids = known.join(tokens.filter("NOT seed"), "value", "left_semi").join(sure.select("value"), "value", "left_semi")
    if marked is None:
        return ids, docs.select("doc_id", "row", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop")).limit(0)
    return ids, marked.join(accepted_slots, "value", "left_semi").select("doc_id", "row", "start", "stop")


def find_personal(docs: DataFrame, **options) -> DataFrame:
    """One row per document row: doc_id, row, base and spans as lists of kind:start:end."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table = stored(extract(docs))
    found = table.select("doc_id", "row", F.inline("found"))
    new, places = discover(found, docs.withColumn("row", row_hash(F.col("text"))), **options)
    spans = found.filter("NOT seed").join(new, "value", "left_semi").unionByName(found.filter("shaped")).select("doc_id", "row", "start", "stop").unionByName(places).distinct()
    earlier = Window.partitionBy("doc_id", "row").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("stop").over(earlier), F.lit(-1))).filter("stop > reach")  # not inside another
    more = spans.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("more")).withColumnsRenamed({"doc_id": "d", "row": "r"})
    joined = table.drop("found").join(more, table["doc_id"].eqNullSafe(more["d"]) & (table["row"] == more["r"]), "left")
    ids = F.transform(F.coalesce("more", F.array().cast("array<struct<start:bigint,stop:bigint>>")), lambda s: F.concat_ws(":", F.lit("id"), s["start"], s["stop"]))
    return joined.select("doc_id", "row", "base", F.concat("base", ids).alias("spans"))


def personal_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")

    return find_personal(docs, **options).select(
        "doc_id", *map(count, KINDS), F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def mask_personal(docs: DataFrame, mask: str = "*", **options) -> DataFrame:
    """`docs` with every code point of every span replaced by `mask`; other texts stay as they are."""
    spans = find_personal(docs, **options).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "row"]).select(
        F.col("doc_id").alias("__d"), F.col("row").alias("__r"), "spans").withColumnRenamed("spans", "__spans")
    marked = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & (row_hash(F.col("text").cast("string")) == F.col("__r")), "left")
    where = marked.schema.names.index("text")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    chars = list(texts[i])
                    for _, a, b in (s.split(":") for s in spans):
                        chars[int(a):int(b)] = mask * (int(b) - int(a))
                    texts[i] = "".join(chars)
            columns = batch.columns
            columns[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return marked.mapInArrow(cover, marked.schema).select(docs.columns)


def op3_pii(spark, folder):
    from stackweave.llm.common import read
    return personal_report(read(spark, folder, "documents"))
