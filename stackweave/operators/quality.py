"""Symbol-resolution quality of one or several trace variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stackweave import schemas as S
from stackweave.functions import scalars as X


def _has(bit: int) -> Column:
    return F.coalesce(F.col("quality").bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def _bit_counts(prefix: str) -> list[Column]:
    return [F.count_if(_has(S.HAS_DSO)).alias(f"{prefix}WithDso"),
            F.count_if(_has(S.HAS_SYMBOL)).alias(f"{prefix}WithSymbol"),
            F.count_if(_has(S.HAS_SOURCE_LINE)).alias(f"{prefix}WithSourceLine")]


def location_quality(locations: DataFrame) -> DataFrame:
    return locations.select("id", X.quality_bits("dso", "symbol", "sourceFileName", "sourceLineNumber")
                            .alias("quality"))


def source_stats(locations: DataFrame) -> DataFrame:
    return location_quality(locations).agg(F.count(F.lit(1)).alias("sourceLocs"), *_bit_counts("source"))


def union_endpoints(branches: DataFrame) -> DataFrame:
    """ip and target of each branch as two rows, from one scan."""
    ends = F.array(F.struct(F.col("ip").alias("address"), F.col("ipLocationId").alias("locationId")),
                   F.struct(F.col("addr").alias("address"), F.col("addressLocationId").alias("locationId")))
    return branches.select(F.explode(ends).alias("e")).select("e.address", "e.locationId")


def nonzero_endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(F.col("address") != 0)


def join_endpoint_quality(endpoints: DataFrame, locations: DataFrame) -> DataFrame:
    """Quality per endpoint; `isMissing` marks an id that the dimension lacks."""
    quality = location_quality(locations).select(F.col("id").alias("locationId"), "quality")
    return (endpoints.join(quality, "locationId", "left")
            .withColumn("isMissing", (F.col("locationId") != 0) & F.col("quality").isNull())
            .withColumn("quality", F.when(F.col("locationId") == 0, F.lit(0))
                        .otherwise(F.coalesce("quality", F.lit(0)))))


def _address_groups(branches: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per (address, location id) with its endpoint count.

    Branch rows repeat few code addresses, so this partial aggregate shrinks the data before the
    dimension join and feeds both the endpoint and the distinct-address measures.
    """
    counted = (nonzero_endpoints(union_endpoints(branches)).groupBy("address", "locationId")
               .agg(F.count(F.lit(1)).alias("endpoints")))
    return join_endpoint_quality(counted, locations)


def branch_endpoint_stats(branches: DataFrame, locations: DataFrame) -> DataFrame:
    def of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("endpoints"))), F.lit(0))

    return _address_groups(branches, locations).agg(
        of(F.lit(True)).alias("addressEndpoints"),
        of(F.col("locationId") != 0).alias("endpointsWithLocationId"),
        of(_has(S.HAS_DSO)).alias("endpointsWithDso"),
        of(_has(S.HAS_SYMBOL)).alias("endpointsWithSymbol"),
        of(_has(S.HAS_SOURCE_LINE)).alias("endpointsWithSourceLine"),
        of(F.col("isMissing")).alias("locationIdsMissing"))


def distinct_address_quality(branches: DataFrame, locations: DataFrame) -> DataFrame:
    merged = _address_groups(branches, locations).groupBy("address").agg(
        F.bit_or("quality").alias("quality"))
    return merged.agg(F.count(F.lit(1)).alias("distinctAddresses"), *_bit_counts("distinct"))


def branch_files(branches: DataFrame) -> DataFrame:
    """Rows and files. One file holds one (pid, tid)."""
    per_file = branches.groupBy("pid", "tid").agg(F.count(F.lit(1)).alias("rows"))
    return per_file.agg(F.count(F.lit(1)).alias("branchFiles"),
                        F.coalesce(F.sum("rows"), F.lit(0)).alias("branchRows"))


REPORT_COLUMNS = [
    "variant", "path", "sourceLocs", "sourceWithDso", "sourceWithSymbol", "sourceWithSourceLine",
    "branchFiles", "branchRows", "addressEndpoints", "endpointsWithLocationId", "endpointsWithDso",
    "endpointsWithSymbol", "endpointsWithSourceLine", "locationIdsMissing", "distinctAddresses",
    "distinctWithDso", "distinctWithSymbol", "distinctWithSourceLine"]


def quality_reports(variants: DataFrame, branches: DataFrame, locations: DataFrame) -> DataFrame:
    """The 16 measures of every (variant, path), one row each; `branches` carry their `variant`.

    One scan of the branches: each row is counted as an endpoint twice and once for its file, and one tagged aggregate
    over (variant, address, location) feeds all measures. It is combined before the shuffle, since branch rows repeat few
    code addresses, and joined with the dimension afterwards.
    """
    address = "decimal(20,0)"
    ends = F.array(
        F.struct(F.lit(True).alias("isEnd"), F.col("ip").cast(address).alias("address"), F.col("ipLocationId").cast("long").alias("locationId")),
        F.struct(F.lit(True).alias("isEnd"), F.col("addr").cast(address).alias("address"), F.col("addressLocationId").cast("long").alias("locationId")),
        F.struct(F.lit(False).alias("isEnd"), F.col("pid").cast(address).alias("address"), F.col("tid").cast("long").alias("locationId")))
    counted = (branches.select("variant", F.inline(ends)).filter("not isEnd or address <> 0")
               .groupBy("variant", "isEnd", "address", "locationId").agg(F.count(F.lit(1)).alias("rows")))
    graded = join_endpoint_quality(counted, locations)
    is_end = F.col("isEnd")

    def rows_of(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(is_end & condition, F.col("rows"))), F.lit(0))

    measures = {
        "branchRows": F.coalesce(F.sum(F.when(~is_end, F.col("rows"))), F.lit(0)),
        "branchFiles": F.count_if(~is_end),  # one file holds one (pid, tid)
        "addressEndpoints": rows_of(F.lit(True)), "endpointsWithLocationId": rows_of(F.col("locationId") != 0),
        "endpointsWithDso": rows_of(_has(S.HAS_DSO)), "endpointsWithSymbol": rows_of(_has(S.HAS_SYMBOL)),
        "endpointsWithSourceLine": rows_of(_has(S.HAS_SOURCE_LINE)), "locationIdsMissing": rows_of(F.col("isMissing"))}
    per_address = graded.groupBy("variant", "isEnd", "address").agg(F.bit_or("quality").alias("quality"), *[v.alias(k) for k, v in measures.items()])
    per_variant = per_address.groupBy("variant").agg(
        *[F.sum(k).alias(k) for k in measures], F.count_if(is_end).alias("distinctAddresses"),
        *[F.count_if(is_end & _has(bit)).alias(f"distinctWith{name}") for bit, name in (
            (S.HAS_DSO, "Dso"), (S.HAS_SYMBOL, "Symbol"), (S.HAS_SOURCE_LINE, "SourceLine"))])
    found = variants.select("variant", "path").join(per_variant, "variant", "left").crossJoin(source_stats(locations))  # one row
    return found.select("variant", "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in REPORT_COLUMNS[2:]])


def quality_report(variant: str, path: str, branches: DataFrame, locations: DataFrame) -> DataFrame:
    """The 16 measures of one variant as one row."""
    variants = branches.sparkSession.createDataFrame([(variant, path)], "variant string, path string")
    return quality_reports(variants, branches.withColumn("variant", F.lit(variant)), locations)


def with_percentages(report: DataFrame) -> DataFrame:
    return report.withColumns({
        "sourceLinePercent": X.percent_text("sourceWithSourceLine", "sourceLocs"),
        "symbolPercent": X.percent_text("endpointsWithSymbol", "addressEndpoints"),
        "endpointLinePercent": X.percent_text("endpointsWithSourceLine", "addressEndpoints")})


def union_variants(reports: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), reports)


def parse_variant(argument: str) -> tuple[str, str]:
    """`label=path`, `label:path`, or a bare path labelled by its last part."""
    at = argument.find("=") if "=" in argument else argument.find(":")
    if at <= 0 or at == len(argument) - 1:
        return argument.rstrip("/").rsplit("/", 1)[-1], argument
    return argument[:at], argument[at + 1:]


def markdown_lines(report: DataFrame) -> DataFrame:
    """The 13-column table as text lines: header, rule, one line per variant."""
    columns = ["variant", "sourceLocs", "sourceWithSourceLine", "sourceLinePercent", "branchRows",
               "addressEndpoints", "endpointsWithSymbol", "symbolPercent", "endpointsWithSourceLine",
               "endpointLinePercent", "distinctAddresses", "distinctWithSymbol", "distinctWithSourceLine"]
    # The report's column titles.
    titles = ["Variant", "Source locs", "Source lines", "Source line %", "Branch rows",
              "Address endpoints", "Endpoint symbols", "Symbol %", "Endpoint source lines",
              "Source line %", "Distinct addresses", "Distinct symbols", "Distinct source lines"]
    head = [f"| {' | '.join(titles)} |", "|---|" + "---:|" * 12]
    spark = report.sparkSession
    header = spark.createDataFrame([(i, line) for i, line in enumerate(head)], "line int, value string")
    body = with_percentages(report).select(
        F.lit(len(head)).alias("line"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
        .alias("value"))
    return header.unionByName(body)
