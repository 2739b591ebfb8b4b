"""Rate windows against brute force."""

import random
import re
from datetime import datetime, timedelta

from stackweave.operators import telemetry as M


def test_rate_history_has_no_sliding_frame(spark):
    """Values of a whole minute meet each row as two running aggregates, not row by row."""
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(i, rng.choice("ab"), start + timedelta(seconds=rng.randint(0, 200)), rng.choice([None, *range(9)])) for i in range(300)]
    rows += [(300, None, start, 5.0), (301, "a", None, 6.0), (302, "c", start, None)]
    rows = [(n, k, t, None if v is None else float(v)) for n, k, t, v in rows]
    table = spark.createDataFrame(rows, "n int, key string, observed timestamp, rate double")
    found = M.rate_history_1m(table, "key", "observed", "rate")
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+), ([^)]+)", found._jdf.queryExecution().optimizedPlan().toString())
    assert frames and {f for f, _ in frames} == {"unboundedpreceding$()"}
    got = {r.n: (r.points, r.meanRate, r.peakRate) for r in found.collect()}
    wanted = {}
    for n, key, at, _ in rows:
        if at is not None:
            near = [v for _, k, t, v in rows if k == key and t is not None and v is not None and at - timedelta(seconds=60) <= t <= at]
            wanted[n] = (len(near), sum(near) / len(near) if near else None, max(near, default=None))
    assert {n: (p, m and round(m, 9), top) for n, (p, m, top) in got.items()} == {n: (p, m and round(m, 9), top) for n, (p, m, top) in wanted.items()}
