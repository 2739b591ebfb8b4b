"""Writers. Each keeps the write parallel and the files in the documented order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stackweave.functions import scalars as X
from stackweave.operators import quality
from stackweave.operators.depths import frame_order


def write_samples(samples: DataFrame, root: str, mode: str = "overwrite", chunk_rows: int = 1 << 22) -> None:
    """Flat samples by pid, tid and event component, each file in id order.

    A busy thread is spread by id range, so it becomes several consecutive files, not one task.
    """
    (samples.withColumn("eventComponent", X.event_component("event"))
     .withColumn("__part", F.call_function("div", F.col("id"), F.lit(chunk_rows)))
     .repartition("pid", "tid", "eventComponent", "__part")
     .sortWithinPartitions("pid", "tid", "eventComponent", "id").drop("__part")
     .write.mode(mode).partitionBy("pid", "tid", "eventComponent").parquet(root))


def write_source_locations(locations: DataFrame, root: str) -> None:
    locations.write.mode("overwrite").parquet(f"{root}/source_locations.parquet")


def write_aux_loss(losses: DataFrame, root: str) -> None:
    losses.write.mode("overwrite").parquet(f"{root}/aux_loss.parquet")


def write_stack_frames(frames: DataFrame, root: str) -> None:
    """Frames ordered by (tid, kind, start order), across files and within them."""
    order = ["tid", "kind", *frame_order()]
    (frames.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").parquet(f"{root}/stack_frames.parquet"))


def write_stack_ranges(ranges: DataFrame, root: str, segment: int = 0) -> None:
    (ranges.select("startTrace", "endTrace").write.mode("overwrite")
     .parquet(f"{root}/segment{segment}_stackranges.parquet"))


def write_trace_events(ordered: DataFrame, path: str, form: str = "parquet") -> None:
    """Ordered trace events; `form` is parquet or json."""
    ordered.write.mode("overwrite").format(form).save(path)


# The report's CSV header.
_CSV_NAMES = [
    "variant", "path", "source_locs", "source_with_dso", "source_with_symbol", "source_with_source_line",
    "branch_files", "branch_rows", "address_endpoints", "endpoints_with_location_id", "endpoints_with_dso",
    "endpoints_with_symbol", "endpoints_with_source_line", "location_ids_missing_from_source_table",
    "distinct_addresses", "distinct_with_dso", "distinct_with_symbol", "distinct_with_source_line"]


def quality_csv(report: DataFrame) -> DataFrame:
    return report.select(*[F.col(c).alias(n) for c, n in zip(quality.REPORT_COLUMNS, _CSV_NAMES)])


def write_quality_csv(report: DataFrame, path: str) -> None:
    """Values are quoted only where they hold a comma, quote or newline."""
    (quality_csv(report).coalesce(1).write.mode("overwrite").option("header", "true")
     .option("escape", '"').csv(path))


def write_quality_markdown(report: DataFrame, path: str) -> None:
    lines = quality.markdown_lines(report)
    lines.coalesce(1).sortWithinPartitions("line", "value").select("value").write.mode("overwrite").text(path)


def write_sampled_stack_report(tables: dict[str, DataFrame], root: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")
