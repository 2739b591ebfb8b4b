"""Readers for trace directories.

Layouts: `pid=<p>/tid=<t>/<event>.parquet` files at any depth, or the partitioned output of
`sinks.write_samples` (`pid=/tid=/eventComponent=`). Unsigned columns, byte strings and plain
strings are all accepted and brought to the types of `schemas`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stackweave import schemas as S
from stackweave.functions import scalars as X


def _typed(df: DataFrame, schema: T.StructType, keep_empty: tuple[str, ...] = ()) -> list[Column]:
    """Columns of `schema` taken from `df` by name, with bytes decoded and empty text as null."""
    columns = []
    for field in schema.fields:
        if field.name not in df.columns:
            value = F.lit(None)
        elif isinstance(field.dataType, T.StringType):
            value = (F.make_valid_utf8(F.col(field.name).cast("string")) if field.name in keep_empty
                     else X.utf8_or_null(field.name))
        else:
            value = F.col(field.name)
        columns.append(value.cast(field.dataType).alias(field.name))
    return columns


def _load(spark: SparkSession, path: str, schema: T.StructType, **keep) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*_typed(df, schema, **keep))


def _load_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return _load(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _ancestors(root: str) -> list[str]:
    """The directory and all above it."""
    path, found = root.rstrip("/"), []
    while path and not path.endswith(":/"):
        found.append(path)
        path = path.rsplit("/", 1)[0] if "/" in path else ""
    return found


def find_upwards(spark: SparkSession, root: str, name: str) -> str | None:
    """First `<directory>/<name>` that exists, from `root` up through its ancestors."""
    for directory in _ancestors(root):
        try:
            spark.read.format("binaryFile").load(f"{directory}/{name}").schema
            return f"{directory}/{name}"
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def read_events(spark: SparkSession, root: str, component: str = "*") -> DataFrame:
    """Rows of one event (or `*` for all) with pid and tid from the directories."""
    try:
        df = (spark.read.option("basePath", root)
              .parquet(f"{root}/pid=*/tid=*/eventComponent={component}"))
        pid, tid = F.col("pid").cast("string").try_cast("long"), F.col("tid").cast("string").try_cast("long")
        stem = F.col("eventComponent").cast("string")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        try:
            # Threads at the root: directories become partition columns, so filters on pid and tid prune files.
            df = spark.read.option("basePath", root).parquet(f"{root}/pid=*/tid=*/{component}.parquet")
            pid, tid = F.col("pid").cast("string").try_cast("long"), F.col("tid").cast("string").try_cast("long")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND" or component == "*":
                raise
            df = (spark.read.option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", f"{component}.parquet").parquet(root))
            path = F.col("_metadata.file_path")
            pid, tid = X.partition_value(path, "pid"), X.partition_value(path, "tid")
        stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)
    columns = [c for c in _typed(df, S.TRACE_SAMPLE)]
    by_name = dict(zip(S.TRACE_SAMPLE.names, columns))
    by_name["pid"] = F.coalesce(pid, F.lit(0).cast("long")).alias("pid")
    by_name["tid"] = tid.alias("tid")
    return df.select(*by_name.values(), stem.alias("eventComponent")).filter(F.col("tid").isNotNull())


def read_branches(spark: SparkSession, root: str) -> DataFrame:
    """Branch rows of all threads. Column and partition pruning reach the scan."""
    return read_events(spark, root, "branches").drop("eventComponent")


def read_source_locations(spark: SparkSession, root: str, search_upwards: bool = False) -> DataFrame:
    """Location dimension; a missing file is empty; of rows with equal id the last one wins."""
    path = f"{root}/source_locations.parquet"
    if search_upwards:
        path = find_upwards(spark, root, "source_locations.parquet") or path
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], S.SOURCE_LOCATION)
    rows = df.select(F.struct(*_typed(df, S.SOURCE_LOCATION)).alias("row"),
                     F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    return (rows.groupBy("row.id").agg(F.max_by("row", "place").alias("row")).select("row.*"))


def read_aux_loss(spark: SparkSession, root: str) -> DataFrame:
    """Losses from the directory or the nearest ancestor that has them; missing means none."""
    path = find_upwards(spark, root, "aux_loss.parquet")
    if path is None:
        return spark.createDataFrame([], S.AUX_LOSS)
    return _load(spark, path, S.AUX_LOSS)


def read_stack_frames(spark: SparkSession, root: str) -> DataFrame:
    """Frames from the directory or the nearest ancestor; a missing file is an error."""
    path = find_upwards(spark, root, "stack_frames.parquet")
    if path is None:
        raise FileNotFoundError(f"no stack_frames.parquet in {root} or above; reconstruct first")
    return _load(spark, path, S.STACK_FRAME)


def read_stack_ranges(spark: SparkSession, root: str) -> DataFrame:
    return _load_or_empty(spark, f"{root}/*_stackranges.parquet", S.STACK_RANGE)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# ---- text ----------------------------------------------------------------------------------

def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an order column: block offset, then place within the block."""
    return spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                          F.monotonically_increasing_id().alias("n")).alias("line"))


def read_symbol_table(lines: DataFrame) -> DataFrame:
    """Symbol listing lines (dso, line, value) to (dso, address, name): code symbols, first name per address."""
    # The listing's letters for code symbols.
    pattern, code = r"^ *([^ ]+) +([^ ]+) +(.+)$", ("T", "t", "W", "w")
    digits, kind, name = (F.regexp_extract("value", pattern, i) for i in (1, 2, 3))
    parsed = (lines.filter(digits.rlike("^[0-9A-Fa-f]{1,16}$") & kind.isin(*code))
              .select("dso", F.conv(digits, 16, 10).cast("decimal(20,0)").alias("address"),
                      name.alias("name"), "line"))
    return parsed.groupBy("dso", "address").agg(F.min_by("name", "line").alias("name"))


def parse_source_line(text: Column) -> Column:
    """`file:line…` to {file, line}; `??`, no digits or line 0 is unknown (null)."""
    value, pattern = _stripped(text), r"^(.+):(\d+)[^:]*$"
    file, number = F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2).try_cast("long")
    known = (file != "") & (file != "??") & number.between(1, 4294967295)
    return F.when(known, F.struct(file.alias("file"), number.alias("line")))


def read_line_table(lines: DataFrame) -> DataFrame:
    """Symboliser answers (dso, address, value) to (dso, address, file, line), the first answer per address.

    Answers are ordered by a column `line` where there is one, else by their text.
    """
    order = F.struct("line" if "line" in lines.columns else "value", F.col("value").alias("text"))
    known = lines.withColumn("s", parse_source_line(F.col("value"))).filter("s is not null")
    return known.groupBy("dso", "address").agg(F.min_by("s", order).alias("s")).select("dso", "address", "s.file", "s.line")


def sampled_stack_records(spark: SparkSession, path: str) -> DataFrame:
    """One record per blank-line separated block of profiler text."""
    return spark.read.option("lineSep", "\n\n").text(path)


def _collapse(symbols: Column) -> Column:
    return F.filter(symbols, lambda s, i: (i == 0) | (s != F.get(symbols, i - 1)))


def parse_sampled_stacks(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of profiler text to one row per sample: time, ip, all symbols and wanted ones, root first.

    A header line is not indented; only `cpu-clock` headers count. Indented lines are
    `<hex> <symbol>[+offset]`, leaf first. Repeats collapse; samples without wanted symbols (the table's `symbol`) drop.
    """
    blocks = F.explode(F.split("value", r"\n[ \t\r]*\n"))
    # A sample starts at each header; lines before the first header of a block belong to none.
    samples = (records.select(blocks.alias("block"))
               .select(F.explode(F.split(F.regexp_replace("block", r"(^|\n)(?=\S)", "$1\u0001"), "\u0001")).alias("text"))
               .filter(F.col("text").rlike(r"^\S")))
    lines = F.split("text", r"\r?\n")
    header = F.element_at(lines, 1)
    parts = F.filter(F.split(_stripped(header), " +"), lambda p: p != "")
    is_time = lambda p: p.rlike(r"^\d+\.\d+:$")
    times = F.filter(parts, is_time)
    first_time = F.array_position(parts, F.get(times, F.lit(0)))
    after_time = F.slice(parts, first_time.cast("int") + 1, F.size(parts))
    named = F.filter(after_time, lambda p: p.endswith(":") & ~is_time(p))
    event_at = F.array_position(after_time, F.get(named, F.lit(0)))
    tail = F.slice(after_time, event_at.cast("int") + 1, F.size(parts))
    is_hex = lambda p: p.rlike("^[0-9A-Fa-f]+$")
    header_ip = F.get(F.filter(tail, is_hex), F.lit(0))
    header_symbol = X.strip_symbol_offset(
        F.get(tail, F.array_position(tail, header_ip).cast("int")))

    def line_symbol(line: Column) -> Column:
        words = F.split(_stripped(line), " +")
        return F.when((F.size(words) >= 2) & is_hex(F.get(words, F.lit(0))),
                      X.strip_symbol_offset(F.get(words, F.lit(1))))

    found = (samples.filter(header.contains("cpu-clock"))
             .select(F.coalesce(X.parse_trace_time(F.rtrim(F.element_at(times, -1), F.lit(":"))), F.lit(0)).alias("time"),
                     F.when(F.size(named) > 0, header_ip).alias("ip"),
                     F.concat(F.array(F.when(F.size(named) > 0, header_symbol)),
                              F.transform(F.slice(lines, 2, F.size(lines)), line_symbol)).alias("raw")))
    known = wanted.select("symbol").filter("symbol is not null").distinct().withColumn("isWanted", F.lit(True))
    lines = (found.withColumn("sample", F.monotonically_increasing_id())
             .select("sample", "time", "ip", F.posexplode(F.array_compact("raw")).alias("place", "symbol")).join(known, "symbol", "left"))
    stack = F.array_sort(F.collect_list(F.struct("place", "symbol", "isWanted")))
    kept = lines.groupBy("sample").agg(F.first("time").alias("time"), F.first("ip").alias("ip"), stack.alias("stack"))
    raw, keep = F.col("stack.symbol"), F.filter("stack", lambda s: s["isWanted"].isNotNull())["symbol"]
    return (kept.withColumn("raw", raw).withColumn("keep", keep).filter(F.size("keep") > 0)
            .select("time", "ip", F.reverse(_collapse(F.col("raw"))).alias("fullSymbols"), F.reverse(_collapse(F.col("keep"))).alias("symbols")))
