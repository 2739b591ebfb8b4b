"""The derived trace as tables, each written once per session and folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from stackweave.operators import sampled, stacks
from stackweave.plans import derive
from stackweave.session import durable

_KNOWN: dict[tuple[str, str], Trace] = {}


class Trace:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def branches(self) -> DataFrame:
        return durable(derive.branches(self.spark, self.sf_dir))

    @cached_property
    def locations(self) -> DataFrame:
        return derive.locations(self.spark, self.sf_dir)

    @cached_property
    def losses(self) -> DataFrame:
        return durable(derive.aux_loss(self.spark, self.sf_dir))

    @cached_property
    def reconstruction(self) -> stacks.Reconstruction:
        return stacks.reconstruct(self.branches, self.locations, self.losses)

    @cached_property
    def frames(self) -> DataFrame:
        return durable(self.reconstruction.frames())

    @cached_property
    def samples(self) -> DataFrame:
        return durable(derive.sampled_stacks(self.spark, self.sf_dir))

    @cached_property
    def by_symbol(self) -> DataFrame:
        from pyspark.sql import functions as F
        wanted = self.samples.select(F.explode("symbols").alias("symbol")).distinct()
        return durable(sampled.frames_by_symbol(self.frames, self.locations, wanted))


def trace(spark: SparkSession, sf_dir: str) -> Trace:
    """The trace of a folder; its tables are shared by all queries of the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        _KNOWN[key] = Trace(spark, sf_dir)
    return _KNOWN[key]


def forget() -> None:
    """Make the next query build its tables again (for timing)."""
    _KNOWN.clear()
