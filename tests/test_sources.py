"""Readers of foreign files and text formats."""

import base64

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stackweave import schemas as S
from stackweave.operators import quality, telemetry
from stackweave.sources import readers, sinks


def unsigned_branches(path, ids, symbol=b"fn"):
    path.parent.mkdir(parents=True)
    count = len(ids)
    pq.write_table(pa.table({
        "id": pa.array(ids, pa.uint64()), "time": pa.array(ids, pa.uint64()), "cpu": pa.array([4294967295] * count, pa.uint32()),
        "ip": pa.array([2**64 - 1] * count, pa.uint64()), "cpumode": pa.array([2] * count, pa.uint8()),
        "ipSym": pa.array([symbol] * count, pa.binary()), "ipComm": pa.array([b""] * count, pa.binary())}), path)


def test_file_layout(spark, tmp_path):
    unsigned_branches(tmp_path / "pid=9/tid=3/branches.parquet", [1, 2])
    unsigned_branches(tmp_path / "pid=10/tid=3/branches.parquet", [1])
    unsigned_branches(tmp_path / "pid=10/tid=x/branches.parquet", [5])
    unsigned_branches(tmp_path / "pid=9/tid=4/cycles.parquet", [7])
    rows = readers.read_branches(spark, str(tmp_path)).orderBy("pid", "id").collect()
    assert [(r.pid, r.tid, r.id) for r in rows] == [(9, 3, 1), (9, 3, 2), (10, 3, 1)]
    assert (int(rows[0].ip), rows[0].cpu, rows[0].ipSym, rows[0].ipComm, rows[0].cpumode) == (2**64 - 1, 4294967295, "fn", None, 2)
    events = readers.read_events(spark, str(tmp_path)).select("tid", "eventComponent", "id").collect()
    assert (4, "cycles", 7) in [tuple(r) for r in events]


def test_missing_files(spark, tmp_path):
    assert readers.read_source_locations(spark, str(tmp_path)).count() == 0
    assert readers.read_aux_loss(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_stack_frames(spark, str(tmp_path))


def test_nearest_ancestor_and_last_duplicate(spark, tmp_path):
    table = spark.createDataFrame([(1, 5, "old"), (2, 6, "b"), (1, 7, "new")], "id long, sourceLineNumber long, symbol string")
    table.coalesce(1).write.parquet(f"{tmp_path}/source_locations.parquet")
    (tmp_path / "a/b").mkdir(parents=True)
    rows = readers.read_source_locations(spark, str(tmp_path / "a/b"), search_upwards=True).orderBy("id").collect()
    assert [(r.id, r.symbol) for r in rows] == [(1, "new"), (2, "b")]
    assert readers.read_source_locations(spark, str(tmp_path / "a/b")).count() == 0


def test_symbol_table_text(spark, tmp_path):
    (tmp_path / "d.txt").write_text("0000000000000010 T first name\n0000000000000010 t second\n  0020 D data\n"
                                    "ffffffffffffffff W top\nnothex T x\n0030 TT two\n                 U undefined\n")
    lines = readers.text_lines(spark, str(tmp_path / "d.txt")).withColumn("dso", F.lit("/d"))
    got = {int(r.address): r.name for r in readers.read_symbol_table(lines).collect()}
    assert got == {16: "first name", 2**64 - 1: "top"}


@pytest.mark.parametrize("text, expected", [
    ("/a/b.c:12", ("/a/b.c", 12)), ("/a:b/c.c:7 (discriminator 3)", ("/a:b/c.c", 7)), ("??:0", None), ("??:5", None),
    ("/a.c:0", None), ("/a.c:?", None), (":5", None), ("/a.c:", None), ("/a.c:99999999999", None)])
def test_source_line(spark, text, expected):
    row = spark.createDataFrame([(text,)], "v string").select(readers.parse_source_line(F.col("v")).alias("s")).first()
    assert (tuple(row.s) if row.s else None) == expected


def test_sampled_stack_text(spark, tmp_path):
    text = ("app 1 10.5: 250000 cpu-clock:u:\n\t4010 leaf+0x1 (/a)\n\t4020 mid+0x2 (/a)\n\t4020 mid+0x9 (/a)\n\t4030 main+0x1 (/a)\n\n"
            "app 1 11.000000001: 1 cpu-clock: 40f0 leaf+0x3 (/a)\n\n"
            "app 1 12.0: 1 cycles:\n\t4010 main+0x1 (/a)\n\n"
            "app 1 13.0: 1 cpu-clock:\n\t4010 other+0x1 (/a)\n"
            "app 1 14.1234567891: 1 cpu-clock:\n\tzz main+0x1 (/a)\n\t4010 main (/a)\n")
    (tmp_path / "s.txt").write_text(text)
    rows = readers.parse_sampled_stacks(readers.sampled_stack_records(spark, str(tmp_path / "s.txt")), spark.createDataFrame([("main",), ("leaf",)], "symbol string"))
    got = [(r.time, r.ip, r.fullSymbols, r.symbols) for r in rows.orderBy("time").collect()]
    assert got == [(10_500_000_000, None, ["main", "mid", "leaf"], ["main", "leaf"]),
                   (11_000_000_001, "40f0", ["leaf"], ["leaf"]),
                   (14_123_456_789, None, ["main"], ["main"])]


def test_snapshot_forms(spark):
    def name(text):
        return base64.b64encode(text.encode()).decode()

    lines = [f"5|1.5|{name('f')},1,2,OPEN;;{name('g')},x,2,OPEN;bad", "7|2", "x|1", "1", "9|1,000.5|3|4|",
             f"9|1|3|4|{name('f')},1,2,A,B|{name('s')},1,2.5|{name('q')},3,4;{name('r')},3,99999999999"]
    rows = telemetry.read_metric_snapshots(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string"))
    got = {r.n: r for r in rows.collect()}
    assert sorted(got) == [0, 1, 4, 5]
    assert [tuple(f) for f in got[0].files] == [("f", 1, 2, "OPEN")] and got[0].firstNs is None
    assert (got[4].currentRate, got[4].firstNs, got[4].files) == (1000.5, 3, [])
    assert got[5].files[0].status == "A,B" and tuple(got[5].stages[0]) == ("s", 1, 2.5)
    assert [tuple(q) for q in got[5].queues] == [("q", 3, 4)]


def test_sample_sink_splits_a_busy_thread_in_id_order(spark, tmp_path):
    rows = spark.range(1, 101).select(
        "id", F.lit(1).cast("long").alias("pid"), F.lit(2).cast("long").alias("tid"), F.lit("branches:u").alias("event"))
    sinks.write_samples(rows, str(tmp_path / "t"), chunk_rows=30)
    back = readers.read_branches(spark, str(tmp_path / "t"))
    assert back.count() == 100 and back.select("pid", "tid").distinct().count() == 1
    assert set(back.columns) == set(S.TRACE_SAMPLE.names)


def test_csv_quotes_only_where_needed(spark, tmp_path):
    locations = spark.createDataFrame([(1, "/d", "s", None, 0)], "id long, dso string, symbol string, sourceFileName string, sourceLineNumber long")
    branches = spark.createDataFrame([(1, 1, 16, 1, 0, 0)], "pid long, tid long, ip long, ipLocationId long, addr long, addressLocationId long")
    reports = quality.union_variants([quality.quality_report(*quality.parse_variant(v), branches, locations) for v in ("a=/x", 'q"=/y,z')])
    sinks.write_quality_csv(reports, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "a,/x,1,1,1,0,1,1,1," in text and '"q""","/y,z",1' in text
    sinks.write_quality_markdown(reports, str(tmp_path / "md"))
    lines = "".join(p.read_text() for p in (tmp_path / "md").glob("*.txt")).splitlines()
    assert lines[2] == "| a | 1 | 0 | 0.00% | 1 | 1 | 1 | 100.00% | 0 | 0.00% | 1 | 1 | 0 |"


@pytest.mark.parametrize("argument, expected", [("a=/x", ("a", "/x")), ("a:/x", ("a", "/x")), ("/p/q/", ("q", "/p/q/")),
                                                ("=x", ("=x", "=x")), ("a=", ("a=", "a="))])
def test_variant_arguments(argument, expected):
    assert quality.parse_variant(argument) == expected


def test_bad_bytes_and_repeated_answers(spark):
    from stackweave.functions import scalars
    from stackweave.sources import readers
    text = spark.createDataFrame([(bytearray(b"fo\xff"),), (bytearray(b""),)], "name binary").select(scalars.utf8_or_null("name").alias("t")).collect()
    assert [r.t for r in text] == ["fo�", None]
    lines = spark.createDataFrame([("d", 5, "b.c:9", 2), ("d", 5, "a.c:7", 1), ("d", 6, "??:0", 3)], "dso string, address long, value string, line long")
    assert [tuple(r) for r in readers.read_line_table(lines).collect()] == [("d", 5, "a.c", 7)]


def test_native_layout_prunes_threads(spark, tmp_path):
    from stackweave.sources import readers
    for tid in (5, 6):
        spark.range(3).selectExpr("id").write.parquet(f"{tmp_path}/pid=1/tid={tid}/branches.parquet")
    found = readers.read_branches(spark, str(tmp_path)).filter("tid = 5")
    assert found.count() == 3
    assert "tid" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]", 1)[0]
