"""A trace derived from the given tables by plain arithmetic.

`events` rows become samples (branches, AUX records, sampled stacks, telemetry counters), `part`
rows become code locations and symbols, `lineitem` rows become address look-ups. Each thread
works in a neighbourhood of 40 addresses, so calls and returns meet on its stack; some targets
are unknown (id 0) or missing from the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stackweave.operators.scans import whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def location_count(spark: SparkSession, sf_dir: str) -> Column:
    """Scalar subquery: number of code locations."""
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()


def nanoseconds(ts: str = "ts") -> Column:
    # The column has no time zone, so the difference does not depend on the session's.
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") * 1000


def _group(number: Column) -> Column:
    return whole(number, 4)


def _symbol(group: Column) -> Column:
    return (F.when(group % 7 == 0, F.lit("main")).when(group % 7 == 6, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("fn"), group.cast("string"))))


def _dso(group: Column) -> Column:
    return F.when(group % 13 == 12, F.lit("")).otherwise(
        F.concat(F.lit("/lib/d"), (group % 16).cast("string")))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    group = _group(key)
    return table(spark, sf_dir, "part").select(
        (key + 1).alias("id"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("buildId"),
        _dso(group).alias("dso"),
        ((key + 1) * 16).cast("decimal(20,0)").alias("relativeAddress"),
        _symbol(group).alias("symbol"),
        F.when(key % 4 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("/src/"), F.lower("p_type"), F.lit(".c"))).alias("sourceFileName"),
        F.when(key % 9 == 0, F.lit(0)).otherwise(F.col("p_size")).cast("long").alias("sourceLineNumber"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its counter `k` and its thread, process and time."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("event_id").alias("seq"), "k", "event_type", "value", "ts",
        (F.col("user_id") % 4 + whole(F.col("k"), 90) * 10).cast("long").alias("pid"),
        F.col("user_id").alias("tid"), nanoseconds().alias("time"),
        (F.col("event_id") % 8).alias("cpu"),
    )


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` dealt evenly: a table of few files would be worked on by as few tasks, and `k` is parsed once."""
    return events(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with branch flags and both endpoints' slots in the address space."""
    count = location_count(spark, sf_dir)
    k, seq, kind = F.col("k"), F.col("seq"), F.col("event_type")
    named = spread_events(spark, sf_dir).withColumn("ipPart", (F.col("tid") * 8 + (k * 7) % 40) % count)
    return (
        named.withColumn("addrPart", (F.col("tid") * 8 + (k * 3 + seq) % 40) % count)
        .withColumn("cpumode", F.when(k % 10 == 0, 1).otherwise(2))
        .withColumn("flags", (
            1 + F.when(kind.isin("click", "view"), 2).when(kind.isin("purchase", "signup"), 4).otherwise(0)
            + F.when(k % 16 == 1, 256).when(k % 16 == 2, 512).otherwise(0)).cast("long"))
        .withColumn("ipLocationId", F.when(k % 19 == 3, 0).when(k % 23 == 5, count + 2)
                    .otherwise(F.col("ipPart") + 1).cast("long"))
        .withColumn("addressLocationId", F.when((k + seq) % 19 == 4, 0)
                    .when((k + seq) % 29 == 6, count + 3)
                    .otherwise(F.col("addrPart") + 1).cast("long"))
        .withColumn("ip", F.when(k % 31 == 7, 0).otherwise((F.col("ipPart") + 1) * 16).cast("decimal(20,0)"))
        .withColumn("addr", F.when(F.col("addressLocationId") == 0, 0)
                    .otherwise((F.col("addrPart") + 1) * 16).cast("decimal(20,0)"))
        .withColumn("ipComm", F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(kind))
        .withColumn("addressComm", F.when(k % 5 == 0, F.lit("worker")))
        .withColumn("ipSym", F.when(k % 3 != 0, F.concat(F.lit("ips"), (k % 7).cast("string"))))
        .withColumn("addressSym", F.concat(F.lit("ads"), (k % 5).cast("string")))
    )


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as a profiler hands them over: resolved endpoints as structs, event names."""
    k = F.col("k")

    def endpoint(part: Column, comm: Column) -> Column:
        group = _group(part)
        return F.struct(
            ((part + 1) * 16).cast("decimal(20,0)").alias("address"),
            (part % 4 * 16).alias("symoff"), _symbol(group).alias("sym"),
            (group * 64 + 16).cast("decimal(20,0)").alias("symStart"),
            (group * 64 + 80).cast("decimal(20,0)").alias("symEnd"),
            _dso(group).alias("dso"), (part % 3).cast("int").alias("symBinding"),
            F.lit(1).alias("is64Bit"), F.when(part % 11 == 0, 1).otherwise(0).alias("isKernelIp"),
            F.when(part % 5 == 0, F.lit("")).otherwise(
                F.concat(F.lit("b"), (part % 25).cast("string"))).cast("binary").alias("buildId"),
            F.lit(0).alias("filtered"), comm.alias("comm"),
        )

    name = (F.when(F.col("event_type") == "click", F.lit("branches"))
            .when(F.col("event_type") == "view", F.lit("branches:u"))
            .when(F.col("event_type") == "error", F.lit("cpu-clock:"))
            .when(F.col("event_type") == "purchase", F.lit("")).otherwise(F.lit("sw ev/é:k")))
    return samples(spark, sf_dir).select(
        "seq", (F.col("seq") * 3).alias("perfId"), "pid", "tid", "time", "cpu", "flags",
        (k + 1).alias("period"), (k * 2).alias("insnCnt"), (k * 5).alias("cycCnt"),
        (k % 7).alias("weight"), "cpumode",
        F.when(k % 6 == 1, 0).otherwise(1).alias("addrCorrelatesSym"), name.alias("event"),
        F.lit(4294967295).alias("machinePid"), F.lit(4294967295).alias("vcpu"),
        endpoint(F.col("ipPart"), F.col("ipComm")).alias("ipResolved"),
        endpoint(F.col("addrPart"), F.col("addressComm")).alias("addressCandidate"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch rows with `id` = arrival order within (pid, tid)."""
    from stackweave.operators.samples import entry_id
    return entry_id(samples(spark, sf_dir))


def aux_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All AUX records; flags say whether data was lost. Half of them tie with a branch row."""
    k = F.col("k")
    return events(spark, sf_dir).filter(F.col("event_type") == "error").select(
        "seq", (F.col("time") + (k % 2) * 500).alias("time"), "pid", "tid", "cpu",
        F.when(k % 9 == 0, 1 + k % 3).otherwise(0).cast("decimal(20,0)").alias("flags"),
    )


def aux_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stackweave.operators.samples import filter_aux_loss, loss_id
    return loss_id(filter_aux_loss(aux_records(spark, sf_dir)))


def sampled_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiler samples: one per event, main and one or two functions of the thread."""
    count = location_count(spark, sf_dir)
    first = _symbol(_group((F.col("tid") * 8 + F.col("k") % 40) % count))
    second = _symbol(_group((F.col("tid") * 8 + (F.col("k") * 3) % 40) % count))
    stack = F.col("stack")
    named = F.filter(stack, lambda s: s.isNotNull())
    samples = spread_events(spark, sf_dir).withColumn("stack", F.array(F.lit("main"), first, second)).withColumn("stack", named)
    return samples.select(
        F.col("seq").alias("sampleId"), "tid", "time", F.hex(F.col("k")).alias("ip"),
        F.filter(stack, lambda s, i: (i == 0) | (s != F.get(stack, i - 1))).alias("symbols"),
    )


def symbol_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol listing lines per DSO, as text."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(c) for c in "TtWwDU"]), (key % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("/lib/d"), (key % 2).cast("string")).alias("dso"),
        F.concat(F.lower(F.lpad(F.hex(whole(key, 2) * 160), 16, "0")), F.lit(" "), kind,
                 F.lit(" "), F.col("p_name")).alias("value"),
        key.alias("line"),
    )


def address_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lookupId"),
        F.concat(F.lit("/lib/d"), (F.col("l_suppkey") % 3).cast("string")).alias("dso"),
        (F.col("l_partkey") * 97 + F.col("l_linenumber")).cast("decimal(20,0)").alias("address"),
    )


def observed() -> Column:
    return F.timestamp_micros(whole(F.col("time"), 1000))


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telemetry line per event; some short, some with bad items or a bad total."""
    k, seq = F.col("k"), F.col("seq")

    def text(value: Column) -> Column:
        return value.cast("string")

    def named(value: Column) -> Column:
        return F.base64(value.cast("binary"))

    key = F.concat(F.lit("pid="), text(F.col("pid")), F.lit("/tid="), text(F.col("tid")), F.lit("/branches.parquet"))
    status = F.when(k % 10 == 0, F.lit("CLOSED")).otherwise(F.lit("BUFFERING"))
    files = F.concat(F.concat_ws(",", named(key), text(k), text(seq), status),
                     F.when(k % 7 == 0, F.lit(";bad,1")).otherwise(F.lit("")))
    elapsed = seq * (1 + k % 2) * F.lit(0.5)
    stages = F.concat_ws(",", named(F.col("event_type")), text(seq), text(elapsed))
    queues = F.concat(named(F.lit("pending")), F.lit(","), text(k), F.lit(",512;"),
                      named(F.lit("resolved")), F.lit(","), text(99 - k), F.lit(",512"))
    total = F.when(k % 20 == 2, F.lit("x")).otherwise(text(seq + 1))
    long_form = F.concat_ws("|", total, text(F.col("value")), F.lit("1704067200000000000"),
                            text(F.col("time")), files, stages, queues)
    short_form = F.concat_ws("|", total, text(F.col("value")), files)
    return events(spark, sf_dir).select(
        "seq", observed().alias("observed"), F.when(k % 20 == 1, short_form).otherwise(long_form).alias("value"))


def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per event type that mostly grows."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("stage"), observed().alias("observed"), "seq",
        (F.col("seq") * (1 + F.col("k") % 2)).alias("counter"), "value")


def sampled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiler text: two blocks per event, leaf first: a cpu-clock sample, and one of another event, which is not read."""
    count = location_count(spark, sf_dir)
    first = _symbol(_group((F.col("tid") * 8 + F.col("k") % 40) % count))
    second = _symbol(_group((F.col("tid") * 8 + (F.col("k") * 3) % 40) % count))
    micros = whole(F.col("time"), 1000)
    stamp = F.concat((whole(micros, 1_000_000)).cast("string"), F.lit("."),
                     F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit(":"))
    header = F.concat(F.lit("app "), F.col("tid").cast("string"), F.lit(" "), stamp, F.lit(" 250000 "))

    def line(symbol: Column) -> Column:
        return F.concat(F.lit("\n    "), F.lower(F.hex(F.col("seq") + 4096)), F.lit(" "),
                        F.coalesce(symbol, F.lit("[unknown]")), F.lit("+0x1f (/lib/app)"))

    stack = F.concat(line(second), line(first), line(first), line(F.lit("main")), line(F.lit("_start")))
    return spread_events(spark, sf_dir).select("seq", F.explode(F.array(
        F.concat(header, F.lit("cpu-clock:u:"), stack), F.concat(header, F.lit("cycles:"), stack))).alias("value"))


def line_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symboliser answers per (dso, address): some unknown, some with trailing notes."""
    key = F.col("p_partkey")
    file = F.concat(F.lit("/src/"), F.lower("p_type"), F.lit(".c:"))
    answer = (F.when(key % 11 == 0, F.lit("??:0")).when(key % 11 == 1, F.lit("??:7"))
              .when(key % 11 == 2, F.concat(file, F.lit("?")))
              .when(key % 11 == 3, F.concat(file, F.col("p_size").cast("string"), F.lit(" (discriminator 2)")))
              .when(key % 11 == 4, F.concat(file, F.lit("0")))
              .otherwise(F.concat(file, F.col("p_size").cast("string"))))
    return table(spark, sf_dir, "part").select(
        _dso(_group(key)).alias("dso"), ((key + 1) * 16).cast("decimal(20,0)").alias("address"), answer.alias("value"))
