"""Exact dedup index, fill-in-the-middle, periodic runs: brute force, round trips and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stackweave.llm import exact, infill, periods, words as W

CLASHING = "doc_id long, text string, digest string, same int, row string, form string, n_units string, kept_id int, batch string, start string"


def clashing(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "d", 1, "r", "f", "u", 2, "b", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# ---- exact dedup ---------------------------------------------------------------------------

def test_copies(spark):
    r = random.Random(3)
    pool = ["One text", "ONE text", "Été", "été", "É", None, "", " ", "x" * 300_000, "x" * 300_000 + "Y", "x" * 300_000 + "y"]
    texts = [r.choice(pool) for _ in range(400)] + ["hot"] * 300
    ids = [i * 7 % 700 for i in range(700)]
    ids[5] = ids[6] = None
    ids[10] = ids[11]
    texts[10] = texts[11] = "Pair"  # one row twice
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(lowered(t), []).append(i)
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    for batches in (1, 2, 5):
        got = exact.copy_report(clashing(spark, texts, ids), batches=batches).collect()
        wanted = sorted((str(i), str(top[lowered(t)]), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in zip(ids, texts))
        assert sorted((str(x.doc_id), str(x.keep_id), x.group_size, x.text_sha256) for x in got) == wanted
        kept = [x for x in got if x.kept]
        assert len(kept) == len(groups) == len({x.text_sha256 for x in kept}) and all(x.doc_id == x.keep_id for x in kept)


def test_index_grows(spark, tmp_path):
    index = exact.DigestIndex.create(spark, str(tmp_path / "index"), 3)
    first = clashing(spark, ["a", "A", "b", None, "b"], [1, 2, 3, 4, 3])
    second = clashing(spark, ["B", "c", "", "C"], [9, 8, None, 7])
    kept = exact.new_documents(index, "first", first)
    assert kept.columns == first.columns
    assert sorted((x.doc_id, x.text) for x in kept.collect()) in ([(2, "A"), (3, "b"), (4, None)],)
    assert [(x.doc_id, x.text) for x in exact.new_documents(index, "second", second).collect()] == [(8, "c")]
    # The same batch again, as after a lost driver: nothing is appended, the same rows come back.
    index.close()
    index = exact.DigestIndex(spark, str(tmp_path / "index"))
    assert [(x.doc_id, x.text) for x in exact.new_documents(index, "second", second).collect()] == [(8, "c")]
    assert index.rows().count() == 4
    copy = index.rewritten(str(tmp_path / "copy"), 5)
    assert sorted(map(str, copy.rows().collect())) == sorted(map(str, index.rows().collect()))
    assert exact.new_documents(copy, "third", first).count() == 0
    assert exact.new_documents(copy, "empty", first.limit(0)).count() == 0 and copy.rows().count() == 4


def test_index_is_not_shuffled(spark, tmp_path):
    index = exact.DigestIndex.create(spark, str(tmp_path / "index"), 6)
    docs = exact.digests_of(clashing(spark, ["a", "b"]))
    fresh = docs.groupBy("digest").count().repartition(6, "digest").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("FileScan")
    assert "SortMergeJoin" in plan and plan[:scan].count("Exchange") == 2 and "Bucketed: true" in plan  # both on the new data's side


def test_copies_of_nothing(spark):
    assert exact.copy_report(clashing(spark, ["a"]).limit(0)).collect() == []


# ---- fill in the middle --------------------------------------------------------------------

def test_infill_round_trip():
    r, seen = random.Random(1), set()
    for k in range(3000):
        text = "".join(r.choice(["a", "é", " ", "\n", "<", "P>", "S", "M>", ">", "漢", "\x0b", "\x85"]) for _ in range(r.randint(0, 40)))
        rule = infill.Infill(plain_percent=k % 3 * 50)
        form, n, out, first, second = infill.encode(text.encode(), k, rule)
        seen.add(form)
        assert infill.decode(out, form, rule) == text.encode()
        units = __import__("re").findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        assert n == len(units)
        if form != "plain":
            h = hashlib.sha256(f"42:{k}".encode()).hexdigest()
            a, b = sorted(int(h[i:i + 8], 16) % (n + 1) for i in (0, 8))
            pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
            assert out.decode() == (f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")
        else:
            assert out == text.encode()
    assert seen == {"plain", "psm", "spm"}


def test_rotation_of_long_blocks():
    data = np.arange(400_000, dtype=np.uint32).astype(np.uint8)
    for start, cut, stop in ((0, 1, 400_000), (7, 200_000, 399_999), (5, 5, 9), (9, 9, 9)):
        held = data.copy()
        infill.rotate(held, start, cut, stop)
        assert (held == np.concatenate((data[:start], data[cut:stop], data[start:cut], data[stop:]))).all()


def test_infill_columns(spark):
    texts = [None, "", " ", "one two three", "<P> held", "w " * 200_000, "one two three"]
    docs = clashing(spark, texts, [0, 1, 2, 3, 4, None, 3])
    rule = infill.Infill(plain_percent=0)
    made = infill.transform(docs, rule)
    assert made.columns == [c for c in docs.columns if c not in ("form", "n_units")] + ["form", "n_units"]
    got = made.collect()
    assert {x.form for x in got if not (x.text or "").strip() and x.doc_id != 2} == {"plain"} and [x.text for x in got if x.doc_id == 0] == [None]
    assert [x.n_units for x in got if x.doc_id in (1, 2)] in ([0, 1], [1, 0])
    back = infill.restore(made, rule)
    assert sorted(str(x.text) for x in back.collect()) == sorted(map(str, texts)) and back.columns == [c for c in docs.columns if c not in ("form", "n_units")]
    report = {x.doc_id: x for x in infill.infill_report(docs, rule).collect()}
    assert report[0].n == 0 and report[0].form == "plain" and report[0].prefix_chars is None and report[None].n == 200_001
    assert report[None].restored_sha256 == hashlib.sha256(texts[5].encode()).hexdigest()
    assert infill.infill_report(docs.limit(0)).collect() == [] and infill.transform(docs.limit(0)).collect() == []


# ---- periodic runs -------------------------------------------------------------------------

def brute(x, least=6, times=4):
    found = {}
    for q in range(1, len(x) // times + 1):
        same = np.concatenate(([False], x[:-q] == x[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop + q - start >= max(least, times * q):
                found.setdefault((start, stop + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


@pytest.mark.parametrize("least, times", [(6, 4), (11, 5)])
def test_runs_against_brute_force(least, times):
    r = random.Random(least)
    for _ in range(300):
        docs = []
        for _ in range(r.randint(1, 6)):
            kinds, doc, wanted = r.choice([1, 2, 2, 3, 6]), [], r.randint(0, 150)
            while len(doc) < wanted:
                doc += [r.randrange(kinds) for _ in range(r.randint(1, 9))] * r.choice([1, 1, 2, 4, 5, 9]) + [r.randrange(kinds) for _ in range(r.randint(0, 3))]
            docs.append(np.array(doc, np.int64))
        got = periods.find_runs(np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))), least, times)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute(d, least, times) for d in docs]


@pytest.mark.parametrize("make", [
    lambda n: np.zeros(n, np.int64),
    lambda n: np.array([bin(i).count("1") % 2 for i in range(n)]),  # Thue-Morse: no run at all
    lambda n: np.arange(n) % 7,
    lambda n: np.random.default_rng(1).integers(0, 2, n),
    lambda n: np.array([int(c) for c in fibonacci(n)]),
])
def test_long_texts(make):
    x = make(6000)
    assert [tuple(v) for v in periods.find_runs(x, np.array([0, len(x)]))[0].tolist()] == brute(x)


def fibonacci(n):
    a, b = "0", "01"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_grammar_derives_the_text():
    text = [1, 2, 1, 2, 3, 1, 2, 3, 1, 1, 1, 1, 1, 2]
    pairs = {}
    for i in range(len(text) - 1):
        pairs.setdefault((text[i], text[i + 1]), []).append(i)
    rules, start = periods.repair(list(text), [p for p in pairs.values() if len(p) > 1], 9)
    assert start[0] == 0 and rules
    for left, size, places in rules:
        assert len({tuple(text[p:p + size]) for p in places}) == 1 and 0 < left < size and len(places) > 1


def test_run_report(spark):
    texts = [None, "", "a", "no run in this text at all", "x " + "a b c " * 4 + "d", "w " * 30_000, "go go go go go go", "go go go go go", "é　é"] + ["x " + "a b c " * 4 + "d"]
    docs = clashing(spark, texts, [3, 4, 5, 6, 7, 8, 9, 10, None, 7])
    got = {x.doc_id: x for x in periods.run_report(docs).collect()}
    assert [(got[i].start, got[i].length, got[i].period, got[i].exponent_milli) for i in (7, 8, 9)] == [(1, 12, 3, 4000), (0, 30_000, 1, 30_000_000), (0, 6, 1, 6000)]
    assert got[10].n_runs == got[3].n_runs == 0 and got[3].start is None and got[3].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[7].runs_sha256 == hashlib.sha256(b"1,12,3\n").hexdigest() and got[7].collapsed_sha256 == hashlib.sha256(b"x a b c d").hexdigest()
    kept = periods.collapse_runs(docs)
    assert kept.columns == docs.columns
    assert sorted(str(x.text) for x in kept.collect() if x.doc_id in (3, 7, 8, 9, 10)) == ["None", "go", "go go go go go", "w", "x a b c d", "x a b c d"]
    assert sorted((x.doc_id, x.start, x.length, x.period) for x in periods.runs_of(docs).collect()) == [(7, 1, 12, 3), (7, 1, 12, 3), (8, 0, 30_000, 1), (9, 0, 6, 1)]
    assert periods.run_report(docs.limit(0)).collect() == [] and periods.runs_of(docs.limit(0)).collect() == []


def test_colliding_words_have_ids_of_their_own():
    a = bytes(97 + bin(i).count("1") % 2 for i in range(2048))
    b = bytes(97 + 98 - c for c in a)
    words = W.split(pa.array([" ".join([a.decode(), b.decode()] * 6)], pa.large_string()), W.SPACES)
    ids = periods.word_ids(words)
    assert len(set(ids.tolist())) == 2


def test_planted_order():
    for doc_id in range(400):
        h, n = zlib.crc32(str(doc_id).encode()), doc_id % 50
        got = periods.planted(doc_id, n)
        if h % 10 or not n:
            assert got is None
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got.tolist() == [i if i < a else a + (i - a) % p for i in range(n)]


# ---- ids of pieces with equal hashes ---------------------------------------------------------

def test_ids_of_colliding_pieces():
    from stackweave.llm import token_files, tokens
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate({97: 98, 98: 97})
    encoder = tokens.Encoder(token_files.default_tokenizer())
    for texts in ([a, b], [b], [a, "x", b, a], ["Ab 12"] * 3):
        ids, counts = encoder.encode(pa.array(texts, pa.large_string()))
        for text, found in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert found.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.encoder_of(token_files.default_tokenizer()) is tokens.encoder_of(token_files.default_tokenizer())


def test_memo_keeps_common_pieces(monkeypatch):
    """A full memo forgets what one run alone has asked for; ids stay those of the library."""
    import pyarrow as pa
    from stackweave.llm import token_files, tokens
    monkeypatch.setattr(tokens, "_MEMO", 60)
    encoder = tokens.Encoder(token_files.default_tokenizer())
    common = "shared words of every run"
    for run in range(12):
        text = common + "".join(f" rare{chr(97 + run)}{chr(97 + k)}qz" for k in range(12))
        ids, _ = encoder.encode(pa.array([text, common, ""], pa.large_string()))
        assert ids.tolist() == [i for t in (text, common) for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
        assert run == 0 or b" every" in encoder.known and len(encoder.known) <= 60
    asked = []
    model, encoder.model = encoder.model, type("Model", (), {"tokenize": lambda self, piece: asked.append(piece) or model.tokenize(piece)})()
    for run in range(12):
        encoder.encode(pa.array([common + f" new{chr(97 + run)}zq" * 2 + "".join(f" odd{chr(97 + run)}{chr(97 + k)}qz" for k in range(12))], pa.large_string()))
    assert not any("every" in piece for piece in asked)


def test_hashes_need_short_tables(monkeypatch):
    """Words of any length are hashed a short stretch at a time; a worker keeps no table of a run's length."""
    from stackweave.llm import words as W
    monkeypatch.setattr(W, "_tables", {})
    data = np.frombuffer(b"some words " * 100_000 + b"x" * 300_000, np.uint8)
    starts = np.append(np.arange(0, 1_100_000, 11), 1_100_000)
    ends = np.append(starts[1:] - 1, len(data))
    found = W.hash_bytes(data, starts, ends)
    assert max(map(len, W._tables.values())) <= 1 << 17
    monkeypatch.setattr(W, "_CHUNK", 1 << 20)
    assert (found == W.hash_bytes(data, starts, ends)).all() and len(set(found.tolist())) == 2
