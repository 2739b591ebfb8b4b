"""Interval searches and the chain walk against brute force."""

import random

import pytest

from stackweave.operators import sampled as P

FRAME = "symbol string, frameId long, tid long, kind int, depth long, startTime long, endTime long, startTrace long, endTrace long"

def random_frames(seed, count=150):
    rng, rows = random.Random(seed), []
    for frame_id in range(1, count + 1):
        start = rng.randint(0, 3000)
        rows.append((rng.choice("abc"), frame_id, rng.randint(1, 3), 0, rng.randint(0, 4), start,
                     start + rng.choice([0, 2, 50, 700, 2500]), rng.randint(1, 3), rng.randint(3, 5)))
    return rows

def holds(frame, time, tolerance):
    return max(frame[5] - tolerance, 0) <= time <= frame[6] + tolerance

def file_order(f):
    return (f[2], f[3], f[5], f[7], -f[6], -f[8], f[1])

def encloses(p, c):
    return p[4] < c[4] and (p[5], p[7]) <= (c[5], c[7]) and (c[6], c[8]) <= (p[6], p[8])

def best_alone(frames, symbol, time, tolerance):
    found = [f for f in frames if f[0] == symbol and holds(f, time, tolerance)]
    return min(found, key=lambda f: (f[4], f[5], file_order(f)))[1] if found else None

def walk(frames, symbols, time, tolerance):
    if len(symbols) > 1:
        leaves = [f for f in frames if f[0] == symbols[-1] and holds(f, time, tolerance)]
        for leaf in sorted(leaves, key=lambda f: (f[5], f[7], file_order(f))):
            chain = [leaf]
            for symbol in symbols[-2::-1]:
                up = [f for f in frames if f[0] == symbol and holds(f, time, tolerance) and encloses(f, chain[0])]
                if not up:
                    break
                chain.insert(0, min(up, key=lambda f: (-f[4], f[5], file_order(f))))
            else:
                return [f[1] for f in chain]
    return [best_alone(frames, s, time, tolerance) for s in symbols]

@pytest.mark.parametrize("seed, grain", [(1, 0), (2, 4), (3, 16)])
def test_containment(spark, seed, grain):
    frames = random_frames(seed)
    samples = [(i, t, s) for i, t in enumerate(range(0, 6000, 97)) for s in "abc"]
    got = P.sample_frame_containment(spark.createDataFrame(samples, "sampleId long, time long, symbol string"),
                                     spark.createDataFrame(frames, FRAME), 20, grain)
    found = {(r.sampleId, r.symbol): r.frameId for r in got.collect()}
    wanted = {(i, s): best_alone(frames, s, t, 20) for i, t, s in samples}
    assert found == {k: v for k, v in wanted.items() if v is not None}

def at_scale(frames, bits):
    return [(*f[:5], f[5] << bits, f[6] << bits, *f[7:]) for f in frames]

def chains_of(spark, frames, samples, tolerance, **more):
    got = P.sampled_stack_match(spark.createDataFrame(samples, "sampleId long, tid long, time long, symbols array<string>"),
                                spark.createDataFrame(frames, FRAME), tolerance, **more).collect()
    chains = {}
    for r in sorted(got, key=lambda r: r.position):
        chains.setdefault(r.sampleId, []).append(r.frameId)
    return chains

@pytest.mark.parametrize("seed, longest", [(1, 4), (3, 9)])
def test_chains(spark, seed, longest):
    frames, rng = random_frames(seed), random.Random(seed)
    samples = [(i, 1, rng.randint(0, 4000), [rng.choice("abc") for _ in range(rng.randint(1, longest))]) for i in range(60)]
    assert chains_of(spark, frames, samples, 20) == {i: walk(frames, s, t, 20) for i, _, t, s in samples}

def test_chains_over_many_chunks(spark):
    frames, rng = random_frames(7), random.Random(7)
    # Frames nested deep enough for long walks, and several at one start.
    frames += [("abc"[i % 3], 1000 + i, 1, 0, i, 10 * i, 4000 - 10 * i, 1, 9) for i in range(9)]
    frames += [("abc"[i % 3], 2000 + i, i % 2, 0, i % 5, 1500, 1500 + 100 * (i % 4), 1 + i % 3, 9) for i in range(12)]
    frames = at_scale(frames, 14)
    samples = [(i, 1, rng.randint(0, 4000) << 14, list("abc"[k % 3] for k in range(rng.choice([1, 2, 3, 6, 9])))) for i in range(50)]
    wanted = {i: walk(frames, s, t, 20 << 14) for i, _, t, s in samples}
    assert chains_of(spark, frames, samples, 20 << 14, chunk_rows=3) == wanted
    assert sum(len(set(c)) > 5 for c in wanted.values()) > 0

def test_chains_of_one_thread(spark):
    frames, rng = random_frames(9), random.Random(9)
    samples = [(i, rng.randint(1, 3), rng.randint(0, 4000), [rng.choice("abc") for _ in range(3)]) for i in range(60)]
    wanted = {}
    for i, tid, t, s in samples:
        chain = walk([f for f in frames if f[2] == tid], s, t, 20)
        mine = [f for f in frames if f[2] == tid and f[0] == s[-1] and holds(f, t, 20)]
        complete = bool(mine) and chain[-1] in {f[1] for f in mine} and is_walk(frames, chain)
        wanted[i] = chain if complete else [best_alone(frames, x, t, 20) for x in s]
    got = chains_of(spark, frames, samples, 20, same_thread=True)
    assert sum(got[i] == wanted[i] for i in wanted) == len(wanted)

def is_walk(frames, chain):
    by_id = {f[1]: f for f in frames}
    return None not in chain and all(encloses(by_id[p], by_id[c]) for p, c in zip(chain, chain[1:]))

def test_no_frame_sample_pairs(spark):
    """Rows of the walks do not depend on how many samples ask."""
    frames = spark.createDataFrame(random_frames(4), FRAME)
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "parent string, child string")
    parents = P.frame_parents(frames, pairs)
    assert parents.count() <= frames.filter("symbol in ('b', 'c')").count()
    found = {(r.child, r.frameId): r.parentId for r in parents.collect()}
    rows = random_frames(4)
    for f in rows:
        up = [p for p in rows if (p[0], f[0]) in (("a", "b"), ("b", "c")) and encloses(p, f)]
        best = min(up, key=lambda p: (-p[4], p[5], file_order(p)))[1] if up else None
        assert found.get((f[0], f[1])) == best

@pytest.mark.parametrize("same_thread, deep", [(False, False), (True, False), (False, True)])
def test_overlaps(spark, same_thread, deep):
    frames = random_frames(1 + deep, 14)
    if deep:  # depths up to 165, three rows a chunk
        frames = [(*f[:4], f[4] * 41 + 1, *f[5:]) for f in at_scale(frames, 16)]
    pairs = [(a, b) for a in "abc" for b in "abc"]
    got = P.nested_overlap(spark.createDataFrame(frames, FRAME), spark.createDataFrame(pairs, "parent string, child string"), same_thread,
                           3 if deep else 1 << 16)
    wanted = {(a, b): any(encloses(p, c) and (not same_thread or p[2] == c[2])
                          for p in frames if p[0] == a for c in frames if c[0] == b) for a, b in pairs}
    assert {(r.parent, r.child): r.overlaps for r in got.collect()} == wanted

def test_symbol_automata(spark):
    rng = random.Random(2)
    names = ["main", "main_loop", "xleafx", "leaf", "", None, "é漢é"] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    symbols = ["main", "leaf", "none", "", "漢", None] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    locations = spark.createDataFrame([(n,) for n in names], "symbol string")
    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    expected = {(n, s) for n in names if n for s in symbols if s is not None and (n == s if s == "main" else s in n)}
    for most in (1 << 16, 7):
        got = [tuple(r) for r in P.symbol_matches(locations, wanted, most, 5).select("locationSymbol", "symbol").collect()]
        assert len(got) == len(set(got)) and set(got) == expected

def test_frames_of_one_instant():
    """The sweep by itself: many frames of few start times, traces and threads."""
    import pyarrow as pa
    from stackweave.operators import frame_sweep as S
    for seed in range(60):
        rng = random.Random(seed)
        rows = []
        for i in range(40):
            start = rng.randint(0, 3)
            rows.append(dict(tid=rng.randint(1, 2), kind=rng.randint(0, 1), depth=rng.randint(0, 5), startTime=start, startTrace=rng.randint(1, 3),
                             endTime=start + rng.randint(0, 3), endTrace=rng.randint(3, 6), frameId=i, child=rng.choice([None, "c"])))
        def encloses_row(p, c):
            return (p["depth"] < c["depth"] and (p["startTime"], p["startTrace"]) <= (c["startTime"], c["startTrace"])
                    and (p["endTime"], p["endTrace"]) >= (c["endTime"], c["endTrace"]))
        order = lambda p: (-p["depth"], p["startTime"], p["tid"], p["kind"], p["startTrace"], -p["endTime"], -p["endTrace"], p["frameId"])
        wanted = {}
        for c in rows:
            up = [p for p in rows if p["child"] is None and encloses_row(p, c)]
            if c["child"] and up:
                wanted[c["frameId"]] = min(up, key=order)["frameId"]
        at, found = S.parents(pa.Table.from_pylist(rows, schema=pa.schema([(n, pa.int64()) for n in S.FIELDS] + [("child", pa.string())])), [])
        assert {rows[i]["frameId"]: p for i, p in zip(at, found)} == wanted

@pytest.mark.parametrize("chunk_rows", [4, 1 << 16])
def test_first_holding_over_many_chunks(spark, chunk_rows):
    """Long intervals cross many chunks: they are kept as one best each, and an interval's rows do not grow with its length."""
    rng = random.Random(chunk_rows)
    held = [("ab"[i % 2], lo, lo + rng.choice([0, 3, 40, 4000]) * 1000, i) for i, lo in enumerate(rng.randint(0, 4000) * 1000 for _ in range(120))]
    asked = [(i, rng.choice("abc"), rng.randint(0, 5000) * 1000) for i in range(200)]
    points = spark.createDataFrame(asked, "sampleId long, symbol string, time long")
    intervals = spark.createDataFrame(held, "symbol string, lo long, hi long, id long").selectExpr("symbol", "lo", "hi", "struct(-id) AS best")
    found = P._first_holding(points, intervals, ["symbol"], 2, chunk_rows)
    wanted = {i: max(h[3] for h in held if h[0] == s and h[1] <= t <= h[2]) for i, s, t in asked if any(h[0] == s and h[1] <= t <= h[2] for h in held)}
    assert {r.sampleId: -r.best[0] for r in found.collect()} == wanted and len(wanted) > 50
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()

def test_overlap_sweep():
    """The sweep by itself, whole and from what an earlier stretch leaves behind, against all pairs."""
    from stackweave.operators import frame_sweep as S
    for seed in range(40):
        rng = random.Random(seed)
        rows = [(rng.choice([None, "x", "y", "z"]), rng.randint(0, 6), rng.randint(0, 20), rng.randint(0, 3)) for _ in range(30)]
        wanted = {a[0] for i, a in enumerate(rows) if a[0] and any(o[0] is None and o[1] < a[1] and o[2:] >= a[2:] for o in rows[:i])}
        early, late = rows[:15], rows[15:]
        opened = S.join_ends(None, S.furthest_ends([r[1:] for r in early if r[0] is None]))
        assert set(S.overlapping(rows, [])) == wanted == {*S.overlapping(early, []), *S.overlapping(late, opened)}
