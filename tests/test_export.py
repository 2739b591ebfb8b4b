"""Slice order, depth consistency, visible reasons and names."""

import pytest

from stackweave.functions import scalars as X
from stackweave.operators import export as E
from pyspark.sql import functions as F

FRAME = ("frameId long, tid long, depth long, startTime long, endTime long, startTrace long, endTrace long, "
         "locationId long, startReason int, endReason int, kind int")


def frames(spark, *rows):
    """(id, tid, depth, start, end, start id, end id, location, start reason, end reason)"""
    return spark.createDataFrame([(*r, 0) for r in rows], FRAME)


def ordered(spark, rows):
    points = spark.createDataFrame(rows, "time long, trace long, depth long, frameId long, isBegin boolean")
    return [(r.frameId, r.isBegin) for r in E.order_slice_endpoints(points.withColumn("isInstant", F.lit(False))).collect()]


B, N = True, False


@pytest.mark.parametrize("rows, expected", [
    ([(10, 3, 2, 2, B), (20, 5, 2, 2, N), (20, 6, 2, 3, B), (30, 7, 2, 3, N)], [(2, B), (2, N), (3, B), (3, N)]),
    ([(10, 1, 1, 1, B), (11, 2, 2, 2, B), (20, 3, 1, 1, N), (20, 3, 2, 2, N)], [(1, B), (2, B), (2, N), (1, N)]),
    ([(10, 1, 1, 1, B), (10, 2, 1, 1, N)], [(1, B), (1, N)]),
    ([(10, 1, 0, 1, B), (11, 2, 1, 2, B), (20, 3, 1, 2, N), (20, 4, 1, 3, B), (20, 5, 1, 3, N), (20, 6, 0, 1, N)],
     [(1, B), (2, B), (2, N), (3, B), (3, N), (1, N)]),
])
def test_endpoint_order(spark, rows, expected):
    assert ordered(spark, rows[::-1]) == expected


def test_zero_length_frame_begins_before_it_ends_and_after_earlier_ends(spark):
    table = frames(spark, (1, 1, 1, 5, 10, 1, 2, 9, 0, 2), (2, 1, 0, 10, 10, 2, 2, 9, 1, 2), (3, 1, 0, 10, 20, 2, 5, 9, 0, 2))
    got = [(r.frameId, r.isBegin) for r in E.order_slice_endpoints(E.slice_endpoints(table)).collect()]
    assert got == [(1, True), (1, False), (3, True), (2, True), (2, False), (3, False)]


def test_visible_depths(spark):
    good = frames(spark, (1, 42, 0, 10, 30, 1, 6, 100, 0, 2), (2, 42, 1, 11, 20, 2, 3, 101, 0, 2), (3, 42, 1, 21, 29, 4, 5, 102, 0, 2))
    assert E.check_visible_depths(good).count() == 0
    skipping = frames(spark, (1, 42, 2, 10, 30, 1, 4, 100, 0, 2), (2, 42, 4, 11, 20, 2, 3, 101, 0, 2))
    assert E.check_visible_depths(skipping).count() > 0
    raised = frames(spark, (1, 42, 2, 10, 20, 1, 2, 100, 0, 2))
    assert E.check_visible_depths(raised).count() == 0


@pytest.mark.parametrize("row", [(1, 42, 0, 10, 20, 1, 2, 100, 0, 3), (2, 42, 0, 30, 40, 3, 4, 100, 1, 2),
                                 (3, 42, 0, 10, 20, 1, 2, 100, 0, 2)])
def test_reasons_that_show_both_ends(spark, row):
    got = E.order_slice_endpoints(E.slice_endpoints(frames(spark, row))).collect()
    assert [r.isBegin for r in got] == [True, False]


def test_well_nested(spark):
    crossing = frames(spark, (1, 7, 0, 0, 10, 1, 3, 1, 0, 2), (2, 7, 1, 5, 15, 2, 4, 1, 0, 2))
    bad = E.check_well_nested(crossing).first()
    assert (bad.violations, bad.maxOpen) == (2, 2)
    nested = frames(spark, (1, 7, 0, 0, 20, 1, 4, 1, 0, 2), (2, 7, 1, 5, 15, 2, 3, 1, 0, 2))
    assert E.check_well_nested(nested, limit=2).first().asDict() == {"tid": 7, "violations": 0, "maxOpen": 2, "overLimit": True}


def test_loss_marker_name(spark):
    row = spark.range(1).select(X.loss_marker_name(F.lit(300), F.lit(4), F.lit(0x20)).alias("n")).first()
    assert row.n == "AUX loss tid=300 cpu=4 flags=0x20"


@pytest.mark.parametrize("chunk_rows", [65536, 1, 5])
def test_thread_name_keeps_sixteen_runs(spark, chunk_rows):
    rows = [(1, 5, i, f"c{i // 2}", None) for i in range(1, 80)] + [(1, 6, 1, None, "t")] + [(1, 7, 1, None, None)]
    rows += [(1, 8, i, "one", None) for i in range(1, 30)]
    table = spark.createDataFrame(rows, "pid long, tid long, id long, ipComm string, addressComm string")
    names = {r.tid: r.threadName for r in E.thread_comm_chain(table, chunk_rows).collect()}
    assert names == {5: " -> ".join(f"c{i}" for i in range(16)), 6: "t", 7: "Thread 7", 8: "one"}


def test_unsigned_hex_and_percent(spark):
    row = spark.range(1).select(X.unsigned_hex(F.lit("18446744073709551615").cast("decimal(20,0)")).alias("h"),
                                X.percent_text(F.lit(1), F.lit(0)).alias("p"), X.percent_text(F.lit(1), F.lit(3)).alias("q"),
                                X.format_trace_time(F.lit(-1)).alias("t")).first()
    assert (row.h, row.p, row.q, row.t) == ("ffffffffffffffff", "0.00%", "33.33%", "-1.999999999s")
