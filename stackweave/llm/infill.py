"""Fill-in-the-middle transformation by in-place block rotation.

A text is cut into units (white space with the word after it; white space at the end is a unit of its own). Two of
its n + 1 unit borders, drawn from a hash of seed and doc_id, part it into prefix, middle and suffix. The sentinels
are inserted into a bytearray of the text, which gives P prefix M middle S suffix; one rotation of two neighbouring
blocks then makes either form: of M middle and S suffix (psm: P prefix S suffix M middle), or of P prefix M middle
and S suffix (spm: S suffix P prefix M middle). A rotation is three reversals, each done in place by swapping stretches
from both ends, so a text needs its own bytes and two stretches, however long. Restoring finds the sentinels, rotates
back and deletes them: the bytes are exactly those of the input.

The form is plain (text unchanged, cuts null) for the empty text, for texts that hold a sentinel, and where the draw
says so. Draws depend on seed and doc_id only, so reruns, partitions and repeated rows agree; a null doc_id is drawn as
the empty string. Null texts count as empty in reports and stay null in `transform`. Empty tables give no rows;
further columns pass through untouched, whatever their names (form columns excepted, see `transform`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stackweave.llm import words as W
from stackweave.llm.common import pieces

STRETCH = 1 << 16


@dataclass(frozen=True)
class Infill:
    """Parameters: sentinels, the seed of the draws, the percentage left plain, and that of spm among the rest."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"
    seed: str = "42"
    plain_percent: int = 50
    spm_percent: int = 80

    def draws(self, doc_id) -> tuple[int, int, int, int]:
        key = f"{self.seed}:{'' if doc_id is None else doc_id}".encode()
        return tuple(int.from_bytes(hashlib.sha256(key).digest()[i:i + 4], "big") for i in range(0, 16, 4))


def reverse(buffer: np.ndarray, start: int, stop: int) -> None:
    """Reverse buffer[start:stop] in place, a stretch from each end at a time."""
    while stop - start > 1:
        size = min(STRETCH, (stop - start) // 2)
        left = buffer[start:start + size].copy()
        buffer[start:start + size] = buffer[stop - size:stop][::-1]
        buffer[stop - size:stop] = left[::-1]
        start, stop = start + size, stop - size


def rotate(buffer: np.ndarray, start: int, cut: int, stop: int) -> None:
    """Exchange the blocks start..cut and cut..stop in place, by three reversals."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, stop)
    reverse(buffer, start, stop)


def unit_ends(text: bytes) -> np.ndarray:
    """Byte positions after each unit: the ends of words, and the end of white space that no word follows."""
    word = ~W.SPACES[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    return np.append(ends, len(text)) if len(text) and not word[-1] else ends


def encode(text: bytes, doc_id, rule: Infill) -> tuple[str, int, bytes, int, int]:
    """(form, number of units, output, first cut, second cut); the cuts are byte positions, 0 and 0 when plain."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = rule.draws(doc_id)
    if not text or h3 % 100 >= 100 - rule.plain_percent or any(s in text for s in (rule.prefix, rule.suffix, rule.middle)):
        return "plain", n, text, 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (int(ends[k - 1]) if k else 0 for k in (low, high))
    held = bytearray(text)
    held[second:second] = rule.suffix
    held[first:first] = rule.middle
    held[0:0] = rule.prefix
    middle = len(rule.prefix) + first
    suffix = middle + len(rule.middle) + second - first
    form = "spm" if h4 % 100 < rule.spm_percent else "psm"
    rotate(np.frombuffer(held, np.uint8), 0 if form == "spm" else middle, suffix, len(held))
    return form, n, bytes(held), first, second


def decode(output: bytes, form: str, rule: Infill) -> bytes:
    """The text from output and form alone: rotate back, delete the sentinels."""
    if form == "plain":
        return output
    held = bytearray(output)
    middle, suffix = held.index(rule.middle), held.index(rule.suffix)
    if form == "psm":  # P prefix | S suffix | M middle
        rotate(np.frombuffer(held, np.uint8), suffix, middle, len(held))
        middle, suffix = suffix, suffix + len(held) - middle
    else:  # S suffix | P prefix M middle
        prefix = held.index(rule.prefix)
        rotate(np.frombuffer(held, np.uint8), 0, prefix, len(held))
        middle, suffix = middle - prefix, len(held) - prefix
    del held[suffix:suffix + len(rule.suffix)], held[middle:middle + len(rule.middle)], held[:len(rule.prefix)]
    return bytes(held)


def _codepoints(data: bytes) -> int:
    return len(data.decode("utf-8", "surrogatepass"))


def _with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(columns.values()), names + list(columns))


def transform(docs: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """`docs` with texts in their form, and the columns `form` and `n_units`; columns of these names are replaced."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            null = batch.column("text").is_null().to_pylist()
            made = [encode(t.encode(), i, rule) for t, i in zip(texts.to_pylist(), batch.column("doc_id").to_pylist())]
            yield _with_columns(batch, text=pa.array([None if none else m[2].decode() for m, none in zip(made, null)], pa.string()),
                                form=pa.array([m[0] for m in made], pa.string()), n_units=pa.array([m[1] for m in made], pa.int64()))

    docs = docs.withColumn("text", docs["text"].cast("string"))
    kept = [f for f in docs.schema if f.name not in ("text", "form", "n_units")]
    made = docs.mapInArrow(rows, T.StructType(kept + [
        T.StructField("text", T.StringType()), T.StructField("form", T.StringType()), T.StructField("n_units", T.LongType())]))
    return made.select([c for c in docs.columns if c not in ("form", "n_units")] + ["form", "n_units"])


def restore(docs: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """`transform` undone: the original texts, without `form` and `n_units`."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            given = batch.column("text").is_null().to_pylist()
            made = [None if null else decode(t.encode(), f, rule).decode() for t, f, null in zip(texts.to_pylist(), batch.column("form").to_pylist(), given)]
            yield _with_columns(batch.drop_columns(["form", "n_units"]), text=pa.array(made, pa.string()))

    kept = [f for f in docs.schema if f.name not in ("text", "form", "n_units")]
    made = docs.mapInArrow(rows, T.StructType(kept + [T.StructField("text", T.StringType())]))
    return made.select([c for c in docs.columns if c not in ("form", "n_units")])


def infill_report(docs: DataFrame, rule: Infill = Infill()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts.to_pylist()):
                text = text.encode()
                form, n, output, first, second = encode(text, doc_id, rule)
                plain = form == "plain"
                out.append((n, form, None if plain else _codepoints(text[:first]), None if plain else _codepoints(text[first:second]),
                            hashlib.sha256(output).hexdigest(), hashlib.sha256(decode(output, form, rule)).hexdigest()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                                             ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    docs = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark, folder):
    from stackweave.llm.common import read
    return infill_report(read(spark, folder, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS INTEGER) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS INTEGER) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
