"""Operators on words against brute force, with nulls, ties, repeated rows, empty and long texts."""

import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from stackweave.llm import common, decontaminate, licenses, near, personal, repeats

SPACE = r"[^\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(parts, by=" "):
    return hashlib.sha256(by.join(parts).encode()).hexdigest()


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ñandú", "A", "a"]
    passage = [r.choice(vocabulary) for _ in range(70)]
    texts = []
    for group in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 8, 20, 60, 130, 300]))]
        if group % 3 == 0:
            base += passage
        for _ in range(r.randint(1, 8)):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n", "  "]).join(words))
    texts += [None, "", "  \n", "a b", "A b", texts[0], texts[0], "x " * 30_000]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("pair_from,triple_from", [(64, 4096), (2, 3)])
def test_near_components(table, pair_from, triple_from):
    texts = corpus(1)
    sets = []
    for t in texts:
        w = re.findall(SPACE, lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = table(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_report(docs, pair_from=pair_from, triple_from=triple_from).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}
    if pair_from == 64:
        kept = near.keep_one_of_each(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in range(len(sets)) if root(i) == i}


def test_repeats(table):
    texts = corpus(2)
    words = [re.findall(SPACE, t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    wanted = {}
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < i for j in range(k, k + 50)}
        wanted[i] = (len(w), len(gone), sha([x for j, x in enumerate(w) if j not in gone]))
    docs = table(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.repeat_report(docs).collect()} == wanted
    assert {r.doc_id: sha(re.findall(SPACE, r.text or "")) for r in repeats.remove_repeats(docs).collect()} == {i: v[2] for i, v in wanted.items()}


def test_decontamination(spark, table):
    texts = corpus(3)
    tests = [texts[5], "x", "", None, "W1, w2. ", " ".join(["q"] * 12), "É ñandú"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(tests)] + [(None, "w3")], "item_id long, text string")
    windows = {}
    for i, t in enumerate([*tests, "w3"]):
        w = re.findall(WORD, lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + min(10, len(w))]), set()).add(i)
    wanted = {}
    for i, t in enumerate(texts):
        w = re.findall(WORD, lower(t))
        hit, items = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k:k + size])):
                    hit |= set(range(k, k + size))
                    items |= found
        items = sorted(str(x) for x in items if x < len(tests))
        wanted[i] = (len(w), len(hit), len(items), sha(items, ","), bool(hit))
    for most in (200_000, 7):
        got = decontaminate.contamination_report(table(texts), benchmark, most_windows=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == wanted
    doubled = table([texts[5], texts[5], None, texts[5]], ids=[3, 3, 3, None])
    same = [sorted(map(str, decontaminate.contamination_report(doubled, benchmark, most_windows=most).collect())) for most in (200_000, 7)]
    assert len(same[0]) == 4 and same[0] == same[1]
    clean = decontaminate.remove_contaminated(table(texts), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, v in wanted.items() if not v[1]}
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(table(texts), benchmark, spans=True).collect()}
    assert all(len(re.findall(WORD, lower(cut[i]))) == v[0] - v[1] for i, v in wanted.items())


def test_licenses(table):
    texts = [None, "", "see the\nMIT\nLicense and mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files",
             "apache licenses", "cc by x CC-BY", "this is licensed under the gnu lesser general public license version 2.1"]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(texts)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 2, 5, "mit")
    assert (got[3].base_labels, got[3].labels) == ("", "mit") and 0.8 <= got[3].score < 1
    assert (got[4].n_base, got[5].n_base, got[5].base_labels) == (0, 2, "cc-by")
    assert got[6].labels == "lgpl" and got[6].n_base == 0


def test_rival_licenses(table):
    texts = [text for _, text in licenses.TEMPLATES]
    texts += ["Released under the\nLicense", "this work is licensed under the gnu affero general public license version 3", "licensed under cc by 4.0",
              "released under the mit license. released under the bsd license.",
              "this work is licensed under a creative commons attribution 4.0 international license and that work is licensed under a creative commons attribution sharealike 4.0 international license"]
    got = [r.labels for r in sorted(licenses.scan_licenses(table(texts)).collect())]
    assert got[:len(licenses.TEMPLATES)] == [label if not text.startswith("licensed under cc by") else f"cc-by,{label}" for label, text in licenses.TEMPLATES]
    assert got[len(licenses.TEMPLATES):] == ["", "agpl", "cc-by", "bsd,mit", "cc-by,cc-by-sa"]


def test_license_windows_against_sql(spark, table):
    r = random.Random(3)
    texts = [None, ""]
    for _ in range(400):
        words = []
        for _ in range(r.randint(1, 4)):
            words += ["x"] * r.choice([0, 1, 20]) + [w for w in r.choice(licenses.TEMPLATES)[1].split() if r.random() < 0.95 for _ in range(1 + (r.random() < 0.05))]
        texts.append("".join(w + r.choice(" \n") for w in words))
    docs = table(texts)
    database = duckdb.connect()
    database.register("documents", docs.toArrow())
    theirs = {x[0]: x[1:] for x in database.execute(f"SELECT doc_id, base_labels, labels, score FROM ({licenses.SQL})").fetchall()}
    assert {x.doc_id: (x.base_labels, x.labels, x.score) for x in licenses.scan_licenses(docs).collect()} == theirs


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans():
    def plain(text):
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                if not (kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "phone" and not 8 <= len(digits) <= 15
                        or kind == "card" and not (16 <= len(digits) <= 19 and personal._luhn(digits))):
                    yield (kind, *m.span())
    r = random.Random(5)
    for i in range(20_000):
        text = "".join(r.choice("a.@1 0-+(%é_9b" if i % 2 else "0123456789 -.+") for _ in range(r.randint(0, 45)))
        assert personal.base_spans(text) == list(plain(text))


def test_discovery(table):
    texts = [f"my login a{i}@b.example is mine" for i in range(8)] + ["my login 55512345 is mine", "on floor 99912345 we met", None, "", "my login 55512345 is mine"]
    got = {r.doc_id: r for r in personal.personal_report(table(texts)).collect()}
    assert got[8].spans == got[12].spans == "id:9:17" and got[8].n_email == 0
    assert got[9].spans == "" and got[10].spans == "" and got[0].spans.startswith("email:9:")
    masked = {r.doc_id: r.text for r in personal.mask_personal(table(texts)).collect()}
    assert masked[8] == "my login ******** is mine" and masked[10] is None


def test_discovery_of_any_form(table):
    key = "k" + "7" * 80
    texts = [f"my login a{i}@b.example is mine" for i in range(8)] + [
        "my login DE89 3704 0044 is mine", "my login bluebird is mine", "my login AB1234 is mine", f"my login {key} is mine", "the bluebird sang", None]
    # only the discovered ids above and below stand after "account"; base matches never do
    texts += [f"my login {n}00000 is mine" for n in (11, 12, 13, 14)] + [f"own account {n}00000 closed" for n in (11, 12, 13, 14)] + ["own account 9988776 closed"]
    got = {r.doc_id: r.spans for r in personal.personal_report(table(texts)).collect()}
    assert [got[i] for i in (8, 9, 10, 11)] == ["id:9:23", "id:9:17", "id:9:15", f"id:9:{9 + len(key)}"]
    assert got[12] == got[13] == "" and got[18] == "id:12:19"


def test_shaped_secrets(table):
    key, account = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "DE89 3704 0044 0532 0130 00"
    texts = [f'the token = "{key}" stood', f"pay to {account} soon", "pay to DE88 3704 0044 0532 0130 00 soon", f"TOKEN = {key.upper()}!!", "a" * 40, "1" * 40,
             "see AKf93hTq0Zx71LmWcVb2Rd8Y here", "HTTPRequestHandlerFactory2Builder", f"mail {key}@b.example", None, "", "e1 " * 50_000 + key]
    got = {r.doc_id: r.spans for r in personal.personal_report(table(texts)).collect()}
    assert got[0] == "id:13:53" and got[1] == f"id:7:{7 + len(account)}" and got[3] == "id:8:48" and got[6] == "id:4:28"
    assert got[2] == got[4] == got[5] == got[7] == got[9] == got[10] == "" and got[8] == "email:5:55" and got[11] == "id:150000:150040"


def test_stop_words_speak_for_nothing(table):
    texts = [f"written by a{i}@b.example today" for i in range(6)] + [f"taken by {w} today" for w in "one of them who went out there with all his men".split()]
    texts += ["signed by 1234567 today"]
    got = {r.doc_id: r.spans for r in personal.personal_report(table(texts)).collect()}
    assert got[len(texts) - 1] == "" and got[0].startswith("email:11:")


def test_wrapped_licenses(table):
    notice = ("Copyright 2020 X\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\n"
              "documentation files (the Software), to deal in it.\n")
    scattered = " ".join(w + " x" * 40 for w in "released under the bsd license".split())
    got = {r.doc_id: r for r in licenses.scan_licenses(table([notice, scattered, "Released under\nthe BSD\n license"])).collect()}
    assert got[0].labels == "mit" and got[0].score == 1 and [(m.first_word, m.n_words) for m in got[0].matches] == [(3, 20)]
    assert got[1].labels == "" and got[2].labels == "bsd"


def test_keep_one_of_each_with_repeated_ids(table):
    one, two, three = ("one two three four five six", "alpha beta gamma delta epsilon zeta", "red green blue black white grey")
    kept = near.keep_one_of_each(table([one, two, one, two, three, one, None], ids=[5, 5, 9, 8, 5, 5, 7])).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(5, one), (5, two), (5, three), (7, "")])


def test_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.range(0, 5000, 1, 1).write.parquet(f"{tmp_path}/t.parquet")
        for make in (lambda: common.read(spark, str(tmp_path), "t"), lambda: common.stored(spark.range(0, 5000, 1, 1))):
            spark.conf.set(key, "10000")
            sizes = make().mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches), "n long").collect()
            assert sum(r.n for r in sizes) == 5000 and max(r.n for r in sizes) <= common.BATCH_ROWS
        spark.conf.set(key, "7")
        common.small_batches(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)


def test_verified_shuffles_texts_once(table, monkeypatch):
    """No table of token arrays is written; parts of a hot set, repeated rows and null ids are compared with its own text."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1:]) for i in range(0, 60, 2)] + [" ".join(words), " ".join(words[:30]), None]
    ids = [*range(30), 7, None, 8]
    docs = table(texts + texts[:3], ids=ids + ids[:3]).select("doc_id", "text")
    kept, keep = [], near.stored
    monkeypatch.setattr(near, "stored", lambda df: kept.append(df.columns) or keep(df))
    monkeypatch.setattr(near, "PART_PAIRS", 4)
    monkeypatch.setattr(near, "BROADCAST_ROWS", 0)
    sets = near.document_sets(docs, 5)
    known = sets.select("set").distinct().filter("set != 0")
    pairs = known.select(near.F.col("set").alias("a")).crossJoin(known.select(near.F.col("set").alias("b"))).filter("a < b")
    found = {(r.a, r.b) for r in near.verified(pairs, docs, sets, 5, (3, 4)).collect()}
    by = {near.set_id(s): set(s.tolist()) for s in near.shingle_sets(pa.array(texts[:-1], pa.large_string()), 5)}
    assert found == {(x, y) for x in by for y in by if x < y and 4 * len(by[x] & by[y]) >= 3 * len(by[x] | by[y])} and found
    assert not any({"tokens", "text"} & set(columns) for columns in kept)


def test_long_lists_are_narrow(table, monkeypatch):
    """Rows of long lists are written without parity bits; leaders, then all pairs that are left, give the components of the texts."""
    passage = " ".join(f"p{i}" for i in range(100))
    texts = [f"{passage} " + " ".join(f"g{g}w{i}" for i in range(22)) + f" c{c}" for g in range(12) for c in range(9)]
    docs, kept, keep = table(texts), [], near.stored

    def noted(df):
        kept.append(keep(df))
        return kept[-1]

    monkeypatch.setattr(near, "stored", noted)
    got = {r.doc_id: r.component_id for r in near.near_report(docs, pair_from=32, triple_from=1000).collect()}
    assert got == {i: i // 9 * 9 for i in range(len(texts))}
    lists = [t for t in kept if {"sig", "set", "root"} <= set(t.columns)]
    assert not lists[0].isEmpty() and not any("bits" in t.columns for t in lists)
