"""Document fingerprints: a homomorphic multiset hash of paragraphs, in Spark's own functions only.

A text's paragraphs are its pieces between line breaks, cut further after punctuation that a space follows, so that
texts of one line can be compared as well. Each paragraph's MD5 gives 120 bits. They are added lane by lane into
a vector of 120 counters modulo 2^19 (three in a 64-bit number, so 40 numbers), with two sums of the hashes
themselves modulo 2^60 and the number of paragraphs modulo 2^60. Addition is commutative: the order of paragraphs does
not matter, and `add` and `subtract` insert and delete paragraphs without the rest of the text. Texts with equal
paragraphs have equal fingerprints.

A lane holding c of n bits set stands for the signed sum 2 c - n, so the vectors are random projections of the
multisets; `likeness` is their cosine, cut at 0 (exact 1 for equal fingerprints; standard error 0.09). Beyond 2^19
paragraphs in a text lanes wrap: equality still holds, likeness does not.

Null texts count as empty; the empty text has one empty paragraph. Null ids come last in the descending order; repeated
ids are ordered by the hash of their texts. A single document is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stackweave.llm.common import id_buckets, row_hash

LANES, STEP = 3, 20
_ONES = sum(1 << STEP * i for i in range(LANES))
_KEEP = _ONES * ((1 << STEP - 1) - 1)
_WIDE = (1 << 60) - 1
MAX_BUCKETS = 4096


def paragraphs(text: str) -> str:
    """SQL for the paragraphs of a text column, lines cut at punctuation before a space."""
    return rf"split(regexp_replace({text}, '([.,;:!?|]) ', '$1\n'), '\n')"


def fingerprint(text: str) -> Column:
    """array<long>: 40 numbers of three lanes, two sums of hashes, the number of paragraphs."""
    digests = f"transform({paragraphs(text)}, p -> md5(p))"
    halves = f"array(transform({digests}, m -> cast(conv(substr(m, 1, 15), 16, 10) as bigint)), transform({digests}, m -> cast(conv(substr(m, 17, 15), 16, 10) as bigint)))"
    lanes = f"transform(sequence(0, {STEP - 1}), i -> aggregate(h, 0L, (a, x) -> (a + (shiftright(x, i) & {_ONES}L)) & {_KEEP}L))"
    total = f"aggregate(h, 0L, (a, x) -> (a + x) & {_WIDE}L)"
    # One-element transform: the hashes are computed once and named.
    return F.expr(f"element_at(transform(array({halves}), g -> concat(flatten(transform(g, h -> {lanes})), transform(g, h -> {total}), array(cast(size(g[0]) as bigint)))), 1)")


def add(a: str, b: str) -> Column:
    """Fingerprint of the paragraphs of two columns together."""
    return F.expr(f"zip_with(transform({a}, (x, i) -> struct(x, i)), {b}, (s, y) -> (s.x + y) & CASE WHEN s.i < {2 * STEP} THEN {_KEEP}L ELSE {_WIDE}L END)")


def subtract(a: str, b: str) -> Column:
    """Fingerprint of `a` after its paragraphs `b` are deleted."""
    return F.expr(f"zip_with(transform({a}, (x, i) -> struct(x, i)), {b}, (s, y) -> CASE WHEN s.i < {2 * STEP} "
                  f"THEN ((s.x | {_ONES << STEP - 1}L) - y) & {_KEEP}L ELSE (s.x + {_WIDE + 1}L - y) & {_WIDE}L END)")


def digest(vector: str) -> Column:
    """SHA-256 of a fingerprint, to print and compare."""
    return F.expr(f"sha2(array_join({vector}, ','), 256)")


def likeness(a: str, b: str) -> Column:
    """0 to 1: cosine of two fingerprints' signed lanes, cut at 0."""
    lane = f"transform(flatten(transform(slice({{0}}, 1, {2 * STEP}), x -> transform(array(0, {STEP}, {2 * STEP}), s -> shiftright(x, s) & {(1 << STEP - 1) - 1}L))), c -> 2 * c - element_at({{0}}, -1))"
    x, y = lane.format(a), lane.format(b)
    dot = "aggregate(zip_with({0}, {1}, (p, q) -> p * q), 0L, (s, v) -> s + v)"
    body = f"{dot.format('z.x', 'z.y')} / sqrt(cast({dot.format('z.x', 'z.x')} as double) * {dot.format('z.y', 'z.y')})"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1.0D ELSE coalesce(greatest(0.0D, element_at(transform(array(named_struct('x', {x}, 'y', {y})), "
                  f"z -> CASE WHEN {dot.format('z.x', 'z.x')} = 0 OR {dot.format('z.y', 'z.y')} = 0 THEN 0.0D ELSE {body} END), 1)), 0.0D) END")


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = 2000) -> DataFrame:
    """`docs` with `next`: a struct of `columns` of the next document in descending doc_id, the first after the last.

    Ids are cut into buckets at approximate quantiles, MAX_BUCKETS at most. Each bucket also gets a copy of the first
    document of the bucket after it, so one window per bucket finds every next document and no task holds all rows.
    """
    bucket, _ = id_buckets(docs, rows_per_bucket, MAX_BUCKETS)
    placed = docs.withColumn("bucket", bucket)
    heads = placed.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), "row")).alias("head"))
    heads = heads.select("bucket", "head.*").collect()  # one row of numbers per bucket
    heads.sort(key=lambda h: (h["doc_id"] is not None, h["bucket"]), reverse=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ghosts = [(heads[(i + 1) % len(heads)]["doc_id"], heads[(i + 1) % len(heads)]["row"], h["bucket"]) for i, h in enumerate(heads)]
    ghosts = docs.sparkSession.createDataFrame(ghosts, f"g_doc {kind}, g_row long, bucket int")
    first = docs.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("row") == F.col("g_row"))).drop("g_doc", "g_row")
    both = placed.withColumn("ghost", F.lit(0)).unionByName(first.withColumn("ghost", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("row"))
    return both.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("ghost = 0").drop("ghost", "bucket")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document row."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", row_hash(F.col("text")))
    printed = with_next(texts.withColumn("fp", fingerprint("text")), ["text", "fp"])
    part = "cast(floor(length(text) / 3) as int)"
    edited = printed.withColumn("edited", F.expr(f"concat(left(text, length(text) - {part}), left(next.text, {part}))"))
    edited = edited.withColumn("edited_fp", fingerprint("edited"))
    return edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digest("fp").alias("fingerprint"),
                         digest("edited_fp").alias("edited_fingerprint"), F.round(likeness("fp", "edited_fp"), 9).alias("near_edited"), F.round(likeness("fp", "next.fp"), 9).alias("near_next"))


def op6_document_fingerprints(spark, folder):
    from stackweave.llm.common import read
    return fingerprint_report(read(spark, folder, "documents"))


_FP = (r"list_concat(list_concat(list_transform(range({step}), lambda i: CAST(list_sum(list_transform(h1, lambda x: (x >> CAST(i AS INTEGER)) & {ones})) AS BIGINT) & {keep}), "
       r"list_transform(range({step}), lambda i: CAST(list_sum(list_transform(h2, lambda x: (x >> CAST(i AS INTEGER)) & {ones})) AS BIGINT) & {keep})), "
       r"[CAST(list_sum(h1) & {wide} AS BIGINT), CAST(list_sum(h2) & {wide} AS BIGINT), CAST(len(h1) AS BIGINT)])").format(step=STEP, ones=_ONES, keep=_KEEP, wide=_WIDE)
_LANE = "list_transform(flatten(list_transform({0}[1:40], lambda x: [x & 524287, (x >> 20) & 524287, (x >> 40) & 524287])), lambda c: 2 * c - {0}[43])"
_DOT = "CAST(list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2])) AS BIGINT)"


def _near(a: str, b: str) -> str:
    x, y = _DOT.format(f"{a}_l", f"{a}_l"), _DOT.format(f"{b}_l", f"{b}_l")
    return (f"round(CASE WHEN {a}_f = {b}_f THEN 1.0 WHEN {x} = 0 OR {y} = 0 THEN 0.0 ELSE "
            f"greatest(0.0, CAST({_DOT.format(f'{a}_l', f'{b}_l')} AS DOUBLE) / sqrt(CAST({x} AS DOUBLE) * {y})) END, 9)")


def _hashed(column: str) -> str:
    pieces = f"string_split(regexp_replace({column}, '([.,;:!?|]) ', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_transform(list_transform({pieces}, lambda p: md5(p)), lambda m: CAST('0x' || substr(m, {{0}}, 15) AS BIGINT))"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM d),
t AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(next, 1, length(text) // 3) AS edited FROM e),
h AS (SELECT doc_id, text, edited, {_hashed('text').format(1)} AS a1, {_hashed('text').format(17)} AS a2, {_hashed('edited').format(1)} AS b1, {_hashed('edited').format(17)} AS b2 FROM t),
f AS (SELECT doc_id, text, edited, {_FP.replace('h1', 'a1').replace('h2', 'a2')} AS a_f, {_FP.replace('h1', 'b1').replace('h2', 'b2')} AS b_f FROM h),
g AS (SELECT *, coalesce(lead(a_f) OVER (ORDER BY doc_id DESC), first_value(a_f) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS n_f FROM f),
l AS (SELECT *, {_LANE.format('a_f')} AS a_l, {_LANE.format('b_f')} AS b_l, {_LANE.format('n_f')} AS n_l FROM g)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(a_f, ',')) AS fingerprint,
       sha256(array_to_string(b_f, ',')) AS edited_fingerprint, {_near('a', 'b')} AS near_edited, {_near('a', 'n')} AS near_next
FROM l
"""
