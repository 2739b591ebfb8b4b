"""Split scans against plain windows over the whole key."""

import random

import pytest
from pyspark.sql import Window, functions as F

from stackweave.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaab"), i, rng.randint(-5, 5), rng.choice([None, i])) for i in range(500)]
    return spark.createDataFrame(data, "k string, seq long, v long, mark long").cache()


def same(spark_rows, left, right):
    assert spark_rows.filter(~F.col(left).eqNullSafe(F.col(right))).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_split_scans(rows, size):
    cut = scans.with_chunk(rows, "seq", size)
    whole = Window.partitionBy("k").orderBy("seq")
    running = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    checks = [
        (scans.split_running_sum(cut, ["k"], ["seq"], "v", "x"), F.sum("v").over(running)),
        (scans.split_running_max(cut, ["k"], ["seq"], "v", "x"), F.max("v").over(running)),
        (scans.split_running_max(cut, ["k"], ["seq"], "v", "x", inclusive=False), F.max("v").over(before)),
        (scans.split_row_number(cut, ["k"], ["seq"], "x"), F.row_number().over(whole).cast("long")),
        (scans.split_last(cut, ["k"], ["seq"], "mark", "x"), F.last("mark", ignorenulls=True).over(running)),
        (scans.split_lag(cut, ["k"], ["seq"], ["v"], "s").withColumn("x", F.col("s.v")), F.lag("v").over(whole)),
    ]
    for got, wanted in checks:
        same(got.withColumn("y", wanted), "x", "y")


def test_dense_numbers_over_gaps(spark):
    rows = spark.range(0, 100_000, 37).withColumnRenamed("id", "at")
    got = scans.dense_numbers(rows, "at", [], "n", 1000)
    same(got.withColumn("y", F.col("at") / 37 + 1).withColumn("y", F.col("y").cast("long")), "n", "y")


@pytest.mark.parametrize("most", [4, 50, 400])
def test_time_chunks(spark, most):
    """Chunks follow time, hold a bounded number of rows, and only long keys have several."""
    rng = random.Random(most)
    base = 1_700_000_000_000_000_000
    data = [("hot", base + rng.choice([rng.randrange(10 ** 13), rng.randrange(10 ** 9), rng.randrange(10 ** 6)])) for _ in range(900)]
    data += [("neg", -rng.randrange(10 ** 12)) for _ in range(300)] + [("short", base)] * min(most, 40)
    cut = scans.time_chunks(spark.createDataFrame(data, "k string, at long").repartition(5), ["k"], "at", most).collect()
    assert len(cut) == len(data) and {r.chunk for r in cut if r.k == "short"} == {0}
    for key in ("hot", "neg"):
        rows = sorted((r.at, r.chunk) for r in cut if r.k == key)
        assert [c for _, c in rows] == sorted(c for _, c in rows)
        sizes = {}
        for at, chunk in rows:
            sizes.setdefault(chunk, []).append(at >> 16)
        assert len(sizes) > 1 or len(rows) <= most
        # Only rows of one 65 us cell may exceed the bound.
        assert all(len(cells) <= most or len(set(cells)) == 1 for cells in sizes.values())
        assert len(sizes) <= 5 * len(rows) / most + 5


def test_entry_states(spark):
    """The two-level scan gives each chunk what all earlier chunks leave, for any length of runs."""
    rows = [(k, c, [c, c % 3]) for k, n in (("a", 23), ("b", 1), ("c", 9)) for c in range(n)]
    local = spark.createDataFrame(rows, "k string, chunk long, state array<long>").repartition(4)
    for fan in (1, 2, 5, 100):
        got = scans.entry_states(local, ["k"], "state", lambda carried, own: (carried or []) + own, fan).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.entry or []) == [v for c in range(r.chunk) for v in (c, c % 3)]


def test_carries_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(scans, "FAN", 3)
    rng = random.Random(8)
    rows = spark.createDataFrame([("a", i, rng.randint(-5, 5), rng.choice([None, None, i])) for i in range(200)], "k string, seq long, v long, mark long")
    cut = scans.with_chunk(rows, "seq", 4)
    whole = Window.partitionBy("k").orderBy("seq")
    running = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for got, wanted in [(scans.split_running_sum(cut, ["k"], ["seq"], "v", "x"), F.sum("v").over(running)),
                        (scans.split_running_max(cut, ["k"], ["seq"], "v", "x"), F.max("v").over(running)),
                        (scans.split_row_number(cut, ["k"], ["seq"], "x"), F.row_number().over(whole).cast("long")),
                        (scans.split_last(cut, ["k"], ["seq"], "mark", "x"), F.last("mark", ignorenulls=True).over(running))]:
        same(got.withColumn("y", wanted), "x", "y")


def test_track_numbers(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice([1, 2, 70_000]), rng.randint(0, 1), rng.randrange(10 ** 8), i) for i in range(400)], "tid long, kind int, at long, n long")
    got = scans.track_numbers(rows, "at", ["at", "n"], "x", 20)
    same(got.withColumn("y", F.row_number().over(Window.orderBy("tid", "kind", "at", "n")).cast("long")), "x", "y")


def test_map_groups(spark):
    """Whole groups in order, also across Arrow batches and with missing keys, without an Arrow stream per group."""
    import pyarrow as pa

    def totals(table, borders):
        k, v = table.column("k").to_pylist(), table.column("v").to_pylist()
        return pa.table({"k": pa.array([k[a] for a in borders[:-1]], pa.int64()),
                         "rows": pa.array([b - a for a, b in zip(borders, borders[1:])], pa.int64()),
                         "sorted": pa.array([v[a:b] == sorted(v[a:b]) for a, b in zip(borders, borders[1:])])})

    rows = spark.range(60_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 1001 > 0 THEN id % 1001 END AS k", "(id * 7919) % 60000 AS v")
    found = scans.map_groups(rows, ["k"], ["v"], totals, "k long, rows long, sorted boolean")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert all(r.sorted for r in got) and {r.k: r.rows for r in got} == {r.k: r["count"] for r in rows.groupBy("k").count().collect()} and len(got) == 1001
