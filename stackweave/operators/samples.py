"""From raw profiler samples to trace rows: ids, gates and the flat 45-column layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stackweave.functions import scalars as X
from stackweave.operators import scans


def entry_id(samples: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Add `id`: 1-based arrival order within (pid, tid), over all events of the thread.

    `seq` is the global arrival order, so a chunk of it holds at most `chunk_rows` rows of any
    thread however hot the thread is.
    """
    cut = scans.with_chunk(samples, "seq", chunk_rows)
    return scans.split_row_number(cut, ["pid", "tid"], ["seq"], "id").drop("chunk")


def loss_id(losses: DataFrame, chunk_rows: int = scans.CHUNK_ROWS) -> DataFrame:
    """Add `id`: 1-based number of the kept losses in file order (`seq`)."""
    return scans.dense_numbers(losses, "seq", [], "id", chunk_rows)


def filter_aux_loss(records: DataFrame) -> DataFrame:
    return records.filter(F.col("flags") != 0)


def gate_branch_target(samples: DataFrame) -> DataFrame:
    """Keep the resolved target only where the sample says it correlates with a symbol."""
    return samples.withColumn(
        "addressResolved", F.when(F.col("addrCorrelatesSym") != 0, F.col("addressCandidate")))


def _endpoint_columns(prefix: str, source: str) -> list[Column]:
    def field(name: str) -> Column:
        return F.col(f"{source}.{name}")

    def number(name: str) -> Column:
        return F.coalesce(field(name), F.lit(0).cast("long"))

    text = F.col(source).isNotNull()
    return [
        number("symoff").alias(f"{prefix}Symoff"),
        F.nullif(field("sym"), F.lit("")).alias(f"{prefix}Sym"),
        number("symStart").cast("decimal(20,0)").alias(f"{prefix}SymStart"),
        number("symEnd").cast("decimal(20,0)").alias(f"{prefix}SymEnd"),
        F.when(text, field("dso")).alias(f"{prefix}Dso"),
        number("symBinding").cast("int").alias(f"{prefix}SymBinding"),
        number("is64Bit").cast("int").alias(f"{prefix}Is64Bit"),
        number("isKernelIp").cast("int").alias(f"{prefix}IsKernelIp"),
        F.when(text, field("buildId")).alias(f"{prefix}BuildId"),
        number("filtered").cast("int").alias(f"{prefix}Filtered"),
        F.nullif(field("comm"), F.lit("")).alias(f"{prefix}Comm"),
    ]


def flatten_samples(samples: DataFrame) -> DataFrame:
    """Resolved sample -> the 45 flat columns; a missing target gives nulls and zeros."""
    zero = F.lit(0).cast("decimal(20,0)")
    return samples.select(
        "id", "perfId", "pid", "tid", "time", "cpu", "flags",
        F.col("ipResolved.address").alias("ip"), "ipLocationId",
        F.coalesce(F.col("addressResolved.address"), zero).alias("addr"), "addressLocationId",
        "period", "insnCnt", "cycCnt", "weight", "cpumode", "addrCorrelatesSym", "event",
        "machinePid", "vcpu", F.lit(None).cast("string").alias("srcFileName"),
        F.lit(0).cast("long").alias("srcLineNumber"),
        *_endpoint_columns("ip", "ipResolved"),
        F.col("addressResolved").isNotNull().alias("haveAddress"),
        *_endpoint_columns("address", "addressResolved"),
    )


def trace_time_range(samples: DataFrame) -> DataFrame:
    """First and last time, and their distance; times above the signed range are left out."""
    valid = F.when(F.col("time").cast("decimal(20,0)") <= 9223372036854775807, F.col("time").cast("decimal(20,0)"))
    return samples.agg(F.min(valid).cast("long").alias("firstNs"), F.max(valid).cast("long").alias("lastNs")).select(
        "firstNs", "lastNs", (F.col("lastNs") - F.col("firstNs")).alias("spanNs"),
        X.format_trace_time(F.col("lastNs") - F.col("firstNs")).alias("spanText"))


def valid_trace_time(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("time").cast("decimal(20,0)") <= 9223372036854775807)


def events_per_file(samples: DataFrame) -> DataFrame:
    return samples.groupBy("pid", "tid", X.event_component("event").alias("eventComponent")).agg(
        F.count(F.lit(1)).alias("rows"))


def aux_scan_summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("scanned"),
                       F.count_if(F.col("flags") != 0).alias("losses"))
