"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table with one row per known text: SHA-256 of the text after lower-casing A-Z, the id kept for it,
and the batch that brought it. New data are reduced to one row per digest (combined before the shuffle, so a third of
all rows may be copies of one text), dealt into the index's buckets, anti-joined with it by sort-merge and appended.
The index itself is never shuffled, and each append writes one sorted file per bucket; `rewritten` merges the files of
many appends and may change the number of buckets. An append is one atomic Spark write that carries its batch's name:
a batch given again after a failure finds its own rows and is not appended twice.

Within a batch the largest doc_id of a text stays; against the index the known text stays, since it is already in use.
So a corpus in which the largest id of all must stay is given in batches of descending ids, as `copy_report` does.

Null texts count as empty. A null doc_id is smaller than any other. Of rows that share text and doc_id one stays. Empty
batches append nothing, empty tables give no rows. Further columns pass through `new_documents` unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stackweave.llm.common import stored
from stackweave.session import shared_folder

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text with more than one of so many rows is joined by broadcast: fewer than so many such texts can exist.
HOT_SHARE = 1000
#: Rows of the index in one bucket when it is laid out (about 300 MB).
BUCKET_ROWS = 1 << 22


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text, null as empty, after lower-casing A-Z only."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # lower() changes other letters too, so only where there are none
    return F.unhex(F.sha2(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), 256))


def unused(columns: list[str], name: str) -> str:
    """`name`, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class DigestIndex:
    """The index in a shared folder; known to a session's catalog, so that Spark sees its buckets, from opening to `close`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        layout = spark.read.parquet(f"{self.path}/layout").first()
        self.buckets, self.name = layout["buckets"], f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id {layout['id_type']}, keep_row BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint") -> DigestIndex:
        spark.createDataFrame([(buckets, id_type)], "buckets int, id_type string").coalesce(1).write.parquet(f"{path.rstrip('/')}/layout")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, batch: str, digests: DataFrame) -> DataFrame:
        """Append the texts of `digests` (digest, doc_id, row) that the index does not know; returns the rows of this batch in it."""
        mine = F.col("batch") == batch
        if self.rows().filter(mine).limit(1).count() == 0:
            texts = digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"))
            known = self.rows().select("digest").hint("merge")
            fresh = texts.repartition(self.buckets, "digest").join(known, "digest", "left_anti")
            fresh.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.lit(batch).alias("batch")).write.insertInto(self.name)
        return self.rows().filter(mine)

    def rewritten(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same index at another path, with one sorted file per bucket."""
        index = DigestIndex.create(self.spark, path, buckets or self.buckets, self.rows().schema["keep_id"].dataType.simpleString())
        self.rows().repartition(index.buckets, "digest").write.insertInto(index.name)
        return index


def digests_of(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, row) of every row; `row` is fixed once the table is stored."""
    return docs.select(digest(docs["text"]).alias("digest"), "doc_id", F.monotonically_increasing_id().alias("row"))


def new_documents(index: DigestIndex, batch: str, docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text the index did not know, one per text (that of the largest doc_id); the index knows them afterwards.

    Join keys are digest and doc_id, so the copies of one text are spread over tasks.
    """
    key, same = unused(docs.columns, "digest"), unused(docs.columns, "same")
    given = stored(digests_of(docs))
    fresh = index.add(batch, given).select("digest", "keep_id")
    rows = given.groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    kept = rows.join(fresh, (rows["digest"] == fresh["digest"]) & rows["doc_id"].eqNullSafe(fresh["keep_id"]), "left_semi")
    kept = kept.select(F.col("digest").alias(key), F.col("doc_id").alias(unused([*docs.columns, key], "kept_id")), F.col("same").alias(same))
    found = docs.withColumn(key, digest(docs["text"])).join(kept.withColumnRenamed(key, f"{key}_"), F.expr(f"`{key}` = `{key}_` AND doc_id <=> `{kept.columns[1]}`"))
    once = found.filter(F.col(same) == 1).select(docs.columns)
    return once.unionByName(found.filter(F.col(same) > 1).dropDuplicates([key]).select(docs.columns))


def copy_report(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document row; the largest doc_id of each text stays.

    The rows go into the index (a new one unless given, which must be empty) in batches of descending doc_id, cut at approximate
    quantiles; ids that are no numbers go in one batch.
    """
    spark = docs.sparkSession
    given = stored(digests_of(docs.select("doc_id", "text")))
    total = given.count()
    if index is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS)
        index = DigestIndex.create(spark, shared_folder(spark), parts, docs.schema["doc_id"].dataType.simpleString())
    numeric = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    cuts = given.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if numeric and batches > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    above = [F.col("doc_id") > c for c in cuts]
    for k in range(len(cuts) + 1):
        inside = F.lit(True) if k == len(cuts) else above[k]
        outside = F.lit(False) if k == 0 else F.coalesce(above[k - 1], F.lit(False))
        index.add(f"{k:06d}", given.filter(inside & ~outside))
    sizes = given.groupBy("digest").agg(F.count("*").alias("group_size")).repartition(index.buckets, "digest")
    groups = stored(sizes.join(index.rows().select("digest", "keep_id", "keep_row").hint("merge"), "digest"))
    index.close()
    hot = F.broadcast(groups.filter(F.col("group_size") * HOT_SHARE > total))
    rare = given.join(hot.select("digest"), "digest", "left_anti").join(groups.filter(F.col("group_size") * HOT_SHARE <= total), "digest")
    return given.join(hot, "digest").unionByName(rare).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op11_exact_dedup(spark, folder):
    from stackweave.llm.common import read
    return copy_report(read(spark, folder, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
