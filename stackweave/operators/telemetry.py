"""Pipeline telemetry: snapshot lines, counters, rates and their displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stackweave.functions import scalars as X
from stackweave.operators import scans

HISTORY_SECONDS = 60
# Observations are chunked by hour for per-key scans.
_CHUNK_MICROS = 3_600_000_000


def _micros(observed: Column) -> Column:
    return F.unix_micros(observed)


# ---- snapshot lines ------------------------------------------------------------------------

def _items(part: Column, width: int, build) -> Column:
    """`;`-separated items of `,`-separated fields; items that do not parse are skipped."""
    texts = F.filter(F.split(part, ";"), lambda item: item != "")
    rows = F.transform(texts, lambda item: build(F.split(item, ",", width)))
    return F.coalesce(F.array_compact(rows), F.array())


def _name(fields: Column) -> Column:
    return F.try_to_binary(F.get(fields, F.lit(0)), F.lit("base64")).cast("string")


def _number(text: Column, kind: str) -> Column:
    cleaned = F.regexp_replace(text, ",", "") if kind == "double" else text
    return F.nullif(F.trim(cleaned), F.lit("")).try_cast(kind)


def _file(fields: Column) -> Column:
    name, buffered, flushed = _name(fields), _number(F.get(fields, F.lit(1)), "long"), _number(F.get(fields, F.lit(2)), "long")
    return F.when((F.size(fields) == 4) & name.isNotNull() & buffered.isNotNull() & flushed.isNotNull(),
                  F.struct(name.alias("file"), buffered.alias("buffered"), flushed.alias("flushed"),
                           F.get(fields, F.lit(3)).alias("status")))


def _stage(fields: Column) -> Column:
    name, count, elapsed = _name(fields), _number(F.get(fields, F.lit(1)), "long"), _number(F.get(fields, F.lit(2)), "double")
    return F.when((F.size(fields) == 3) & name.isNotNull() & count.isNotNull() & elapsed.isNotNull(),
                  F.struct(name.alias("stage"), count.alias("count"), elapsed.alias("elapsedMs")))


def _queue(fields: Column) -> Column:
    name, depth, capacity = _name(fields), _number(F.get(fields, F.lit(1)), "int"), _number(F.get(fields, F.lit(2)), "int")
    return F.when((F.size(fields) == 3) & name.isNotNull() & depth.isNotNull() & capacity.isNotNull(),
                  F.struct(name.alias("queue"), depth.alias("depth"), capacity.alias("capacity")))


def read_metric_snapshots(lines: DataFrame) -> DataFrame:
    """Snapshot lines (`value`, other columns kept) to totals and lists of files, stages, queues.

    Two to four fields: total, rate, files. Five or more: total, rate, first, last, files,
    stages, queues. A line whose totals do not parse is dropped.
    """
    parts = F.split("value", r"\|", 7)
    size = F.size(parts)

    def part(index: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(index)), F.lit(""))

    long_form = size >= 5
    parsed = lines.select(
        *[c for c in lines.columns if c != "value"],
        _number(part(0), "long").alias("totalEvents"), _number(part(1), "double").alias("currentRate"),
        F.when(long_form, _number(part(2), "long")).alias("firstNs"),
        F.when(long_form, _number(part(3), "long")).alias("lastNs"),
        _items(F.when(long_form, part(4)).otherwise(part(2)), 4, _file).alias("files"),
        _items(F.when(long_form, part(5)).otherwise(""), 3, _stage).alias("stages"),
        _items(F.when(long_form, part(6)).otherwise(""), 3, _queue).alias("queues"))
    return parsed.filter("totalEvents is not null and currentRate is not null")


def snapshot_items(snapshots: DataFrame, column: str) -> DataFrame:
    """One row per list item, with its place in the list as `item`."""
    kept = [c for c in snapshots.columns if c not in ("files", "stages", "queues")]
    return (snapshots.select(*kept, F.posexplode(column).alias("item", "i"))
            .select(*kept, "item", "i.*"))


# ---- rates ---------------------------------------------------------------------------------

def rate_from_counter(rows: DataFrame, key: str, observed: str, counter: str, out: str = "rate") -> DataFrame:
    """Non-negative increase of a counter per second since the key's previous observation, rounded.

    Null on a key's first observation and where no time has passed.
    """
    cut = rows.withColumn("chunk", scans.whole(_micros(F.col(observed)), _CHUNK_MICROS))
    stepped = scans.split_lag(cut, [key], [observed, counter], [observed, counter], "__previous")
    seconds = (_micros(F.col(observed)) - _micros(F.col(f"__previous.{observed}"))) / F.lit(1e6)
    grown = F.greatest(F.col(counter) - F.col(f"__previous.{counter}"), F.lit(0))
    return (stepped.withColumn(out, F.when(seconds > 0, F.bround(grown / seconds)).cast("long"))
            .drop("__previous", "chunk"))


def overall_rate(snapshots: DataFrame, observed: str = "observed") -> DataFrame:
    """Events over the time between first and last observation with events."""
    seen = snapshots.filter("totalEvents > 0").agg(
        F.max_by("totalEvents", F.struct(observed, "totalEvents")).alias("events"), F.min(observed).alias("first"),
        F.max(observed).alias("last"), F.max_by("currentRate", F.struct(observed, "totalEvents", "currentRate")).alias("current"))
    seconds = (_micros(F.col("last")) - _micros(F.col("first"))) / F.lit(1e6)
    return seen.select("events", F.when(seconds > 0, F.bround(F.col("events") / seconds))
                       .otherwise(F.col("current").cast("long")).cast("long").alias("overallRate"))


def rate_history_1m(rows: DataFrame, key: str, observed: str, rate: str,
                    seconds: int = HISTORY_SECONDS) -> DataFrame:
    """Points, mean and peak of a key's rate over the minute up to each observation.

    Rows are copied to their own and the next minute, so the sliding window runs in one
    (key, minute) group and a busy key spreads over its minutes. A row's window is the end of the minute
    before, from the row's place in its own minute on, and its own minute up to there: two running
    aggregates, so the cost does not grow with the number of rows in a window.
    """
    span = seconds * 1_000_000
    own = scans.whole(_micros(F.col(observed)), span)
    copies = rows.withColumn("__own", own).withColumn("__place", _micros(F.col(observed)) - F.col("__own") * span).withColumn(
        "__bucket", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    is_own = F.col("__own") == F.col("__bucket")
    group = Window.partitionBy(key, "__bucket")

    def running(value: Column, order: Column, name: str) -> dict[str, Column]:
        window = group.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        total = value if rows.schema[rate].dataType.typeName() == "decimal" else value.cast("double")
        return {f"__points{name}": F.count(value).over(window), f"__sum{name}": F.sum(total).over(window),
                f"__peak{name}": F.max(value).over(window)}

    both = copies.withColumns({**running(F.when(~is_own, F.col(rate)), F.col("__place").desc(), "Before"),
                               **running(F.when(is_own, F.col(rate)), F.col("__place").asc(), "Own")}).filter(is_own)
    points = F.col("__pointsBefore") + F.col("__pointsOwn")
    total = F.coalesce("__sumBefore", F.lit(0)) + F.coalesce("__sumOwn", F.lit(0))
    mean = F.when(points > 0, total / points).cast(rows.select(F.avg(rate)).schema[0].dataType)
    return both.withColumns({"points": points, "meanRate": mean, "peakRate": F.greatest("__peakBefore", "__peakOwn")}).drop(
        "__own", "__bucket", "__place", *[f"__{v}{n}" for v in ("points", "sum", "peak") for n in ("Before", "Own")])


def file_status(files: DataFrame, observed: str = "observed") -> DataFrame:
    """Last status, counts and rate per file; a closed file has rate 0 and a closing time."""
    rated = rate_from_counter(files, "file", observed, "flushed")
    last = rated.groupBy("file").agg(
        F.max_by(F.struct("status", "buffered", "flushed"), F.struct(observed, "flushed", "buffered", "status")).alias("s"),
        F.max_by("rate", F.when(F.col("rate").isNotNull(), F.struct(observed, "flushed", "rate"))).alias("lastRate"),
        F.max(F.when(F.col("status") == "CLOSED", F.col(observed))).alias("closedAt"),
        F.max(observed).alias("lastActivity"))
    return last.select("file", "s.*", F.when(F.col("s.status") == "CLOSED", F.lit(0))
                       .otherwise(F.coalesce("lastRate", F.lit(0))).cast("long").alias("rate"),
                       "closedAt", "lastActivity")


def expire_closed(status: DataFrame, now: Column, seconds: int = 10) -> DataFrame:
    """Drop files closed more than `seconds` before `now`."""
    age = (_micros(now) - _micros(F.col("closedAt"))) / F.lit(1e6)
    return status.filter(~((F.col("status") == "CLOSED") & (age > seconds)) | F.col("closedAt").isNull())


def top_active_files(status: DataFrame, top: int = 16) -> DataFrame:
    """The files with the latest activity, then by name; their key split into its parts."""
    return (status.orderBy(F.desc("lastActivity"), "file").limit(top)
            .select("*", X.split_file_key("file").alias("parts")).select("*", "parts.*").drop("parts"))


def pipeline_bottleneck(stages: DataFrame, snapshot: str = "observed", observed: str = "observed") -> DataFrame:
    """Per snapshot: the stage with the largest increase of elapsed ms per second, if any grew."""
    cut = stages.withColumn("chunk", scans.whole(_micros(F.col(observed)), _CHUNK_MICROS))
    stepped = scans.split_lag(cut, ["stage"], [observed, "item"], [observed, "elapsedMs"], "__previous")
    seconds = (_micros(F.col(observed)) - _micros(F.col(f"__previous.{observed}"))) / F.lit(1e6)
    grown = F.greatest(F.col("elapsedMs") - F.col("__previous.elapsedMs"), F.lit(0.0))
    paced = stepped.withColumn("msPerSecond", F.when(seconds > 0, grown / seconds).otherwise(F.lit(0.0)))
    rank = F.struct("msPerSecond", (-F.col("item")).alias("i"))
    best = paced.groupBy(snapshot).agg(F.max_by(F.struct("stage", "msPerSecond"), rank).alias("b"))
    active = F.col("b.msPerSecond") > 0
    return best.select(snapshot, F.when(active, F.col("b.stage")).alias("stage"),
                       F.when(active, F.col("b.msPerSecond")).alias("msPerSecond"),
                       F.when(active, F.concat("b.stage", F.lit(" ("), F.format_string("%.0f", "b.msPerSecond"),
                                               F.lit(" ms/s)")))
                       .otherwise("No active pipeline pressure").alias("text"))


def queue_depths(queues: DataFrame, observed: str = "observed") -> DataFrame:
    """Latest depth and capacity per queue."""
    return (queues.groupBy("queue").agg(F.max_by(F.struct("depth", "capacity"), F.struct(observed, "item")).alias("q"))
            .select("queue", "q.*"))


def downsample_history(points: DataFrame, value: str, buckets: int, position: str = "position") -> DataFrame:
    """Mean per bucket of n points cut by index into `buckets`; fewer points stay as they are.

    `position` is 0-based and dense. Bucket b covers positions floor(b*n/k) .. floor((b+1)*n/k)-1.
    """
    count = points.agg(F.count(F.lit(1))).scalar()
    at = F.when(count <= buckets, F.col(position)).otherwise(
        F.call_function("div", (F.col(position) + 1) * buckets - 1, count))
    return points.groupBy(at.alias("bucket")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("points"))


def event_totals(rows: DataFrame, observed: str = "observed", length: str = "1 second") -> DataFrame:
    """Events per tumbling window; works on a stream as well."""
    return rows.groupBy(F.window(observed, length).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("start"), "events")
