"""Pages, mixing, fingerprints, toxicity and token files: hand-made cases, brute force and round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stackweave.llm import fingerprints, mixing, pages, token_files, toxicity
from stackweave.llm.tokens import Encoder

PAGE = ('<html><head><title>x</title></head><body><header>top</header><nav>menu</nav><div class="cookie-notice">we use</div><main><article>'
        '<h1>T &amp; U</h1><p>One<br>two <b>three<p>four &lt;x&gt;</p><ul><li>a<li>b</ul><div class="ad">buy</div><aside>side</aside><script>if(a<b){}</script></article>'
        '<section class="comments"><article class="comment"><p>rant</p></article></section></main><footer>foot</footer>')


def test_page_text(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Our shop sells</div><div><p>Page number {i} tells of {i * 7}</p></div></body>") for i in range(8)]
    rows += [(20, "http://g.example/", PAGE), (21, None, None), (22, "http://g.example/2", ""), (22, "http://g.example/2", ""), (23, "x", "<p>cut &am")]
    got = {r.page_id: r for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20].text == "T & U One two three four <x> a b" and got[20].n_chars == len(got[20].text)
    assert [got[i].text for i in range(8)] == [f"Page number {i} tells of {i * 7}" for i in range(8)]
    assert got[21].text == got[22].text == "" and got[23].text == "cut &am"


def test_permutation_and_shards():
    for n in (1, 2, 3, 100):
        assert sorted(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))) == list(range(n))
    totals, seen = np.array([100, 37, 5, 0]), np.zeros(4, int)
    for s in range(15):
        held, before = mixing.shard_counts(s, 15, 10, totals, 1)
        assert (before == seen).all()
        seen += held
    assert (seen == totals).all()
    assert mixing.targets(np.array([10.0, 1000.0, 1000.0]), np.array([5.0, 2.0, 1.0]), 3).tolist() == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 900))), ["a", "b", "é", None][i % 4]) for i in range(80)] + [(90, None, "a"), (91, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    again = {x.doc_id: x.taken for x in mixing.mix_report(docs).collect()}
    assert {x.doc_id: x.taken for x in got} == again and len(got) == len(rows)
    sources = dict((x[0], x[2]) for x in rows)
    for source in ("a", "b", "é", None, "z"):
        mine = [x for x in got if sources[x.doc_id] == source]
        assert all(x.taken <= 3 * x.size for x in mine) and sum(x.size for x in mine) == mine[0].source_size
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 1
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns and sum(len(x.text.split()) for x in texts.collect()) == sum(x.taken for x in got)


def test_mix_of_repeated_rows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{i}" for _ in range(r.randint(0, 400))), ["a", "b", "c", None][i % 4]) for i in range(40)] * 2 + [(7, "one two three", "a")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and sorted((x.doc_id, x.size) for x in got) == sorted((i, len(t.split())) for i, t, _ in rows)
    emitted = {}
    for x in mixing.mixed_documents(docs).collect():
        emitted[x.doc_id] = emitted.get(x.doc_id, 0) + len(x.text.split())
    reported, taken = {}, {}
    for x in got:
        reported[x.doc_id] = reported.get(x.doc_id, 0) + x.taken
        source = (x.source_size, x.target)
        taken[source] = taken.get(source, 0) + x.taken
        assert x.taken <= 3 * x.size
    assert {k: v for k, v in reported.items() if v} == emitted
    assert all(abs(v - target) <= 1 for (_, target), v in taken.items())


def test_mix_shuffles_slots(spark, table):
    plan = mixing.mix(table(["a b c"] * 50, source="s"))[2]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [number" in plan


def test_large_draws():
    held = np.array([3_000_000_000, 1_000_000_000, 5, 0])
    draws = np.array([mixing.draw(np.random.default_rng(i), held, 1_000_000_000) for i in range(300)])
    assert (draws.sum(1) == 1_000_000_000).all() and (draws >= 0).all() and (draws <= held).all()
    spread = (1e9 * 0.75 * 0.25 * 0.75) ** 0.5
    assert abs(draws[:, 0].mean() - 750_000_000) < 4 * spread / 300 ** 0.5 and 0.85 < draws[:, 0].std() / spread < 1.15


def test_fingerprints(spark, table):
    texts = ["One. Two. Three.", "Two. One. Three.", "One. Two.", None, "", "Three.", "é\nñ", "One. Two. Three."]
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(table(texts)).collect()}
    assert got[0].fingerprint == got[7].fingerprint and got[3].fingerprint == got[4].fingerprint and got[0].fingerprint != got[2].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert got[4].near_next == 1.0 and got[2].n_chars == 9
    df = spark.createDataFrame([("One. ", "Two. ", "One. Two. ")], "a string, b string, c string")
    parts = {c: fingerprints.fingerprint(f"regexp_replace({c}, ' $', '')") for c in "abc"}
    row = df.select(*[v.alias(k) for k, v in parts.items()]).select(
        (fingerprints.add("a", "b") == fingerprints.F.col("c")).alias("x"), (fingerprints.subtract("c", "b") == fingerprints.F.col("a")).alias("y")).first()
    assert row.x and row.y


def test_automaton():
    automaton = toxicity.trie_automaton(["idiot", "scum", "réeux"])
    words = toxicity.W.split(pa.array(["Idiot idot 1diots idiiot scum scam réeuxan réuxan idio dot"], pa.large_string()), toxicity.W.PUNCTUATION, True)
    at, terms, distance = toxicity.find_hits(words, automaton)
    assert dict(zip(at.tolist(), zip(terms.tolist(), distance.tolist()))) == {0: (0, 0), 1: (0, 1), 2: (0, 1), 3: (0, 1), 4: (1, 0), 6: (2, 0), 8: (0, 1)} | (
        {7: (2, 1)} if 7 in at else {})


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_rows(docs, labels))
    rows = toxicity.toxicity_report(docs, model).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right >= 0.9 and all(r.predicted == 0 for r in rows if r.toxic == 0)


def test_toxicity_learns_every_certain_stem(spark):
    terms = [f"{a}{b}{c}zq" for a in "bdfgk" for b in "aeiou" for c in "lmnpr"]
    rows = [(i, f"some {terms[i % 125]} here", 1) for i in range(30 * 125)] + [(-i, "some words here", 0) for i in range(1, 30 * 125)]
    learned = toxicity.learn_terms(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), ())
    assert len(learned) == 125 and all(any(t.startswith(s) for s in learned) for t in terms)


def test_toxicity_edges(table, spark):
    docs = table([None, "", "you idiot", "fine"])
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.toxicity_report(docs, model).collect()}
    assert got[0] == got[1] == got[3] < got[2]
    assert toxicity.remove_toxic(docs, model).columns == docs.columns


def test_coder_round_trip():
    for n in (0, 1, token_files.LANES + 1, token_files.CHECK + 5):
        ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 3000).astype(np.uint32)
        coder = token_files.Coder(token_files.normalised(np.bincount(ids, minlength=5)))
        states, payload, marks = coder.encode(ids)
        assert (coder.decode(n, states, payload) == ids).all()
        if n > token_files.CHECK:
            assert (coder.decode_from(0, n, payload, marks) == ids[token_files.CHECK:]).all()
    assert token_files.crc_join(zlib.crc32(b"abc"), zlib.crc32(b"de"), 2) == zlib.crc32(b"abcde")


def test_coder_looks_symbols_up_once_a_block():
    asked = []

    class Table(np.ndarray):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

        def take(self, *args, **options):
            asked.append(args)
            return np.asarray(self).take(*args, **options)

    ids = np.random.default_rng(3).integers(0, 50, 20 * token_files.LANES + 7).astype(np.uint32)
    coder = token_files.Coder(token_files.normalised(np.bincount(ids)))
    coder.freq, coder.low = coder.freq.view(Table), coder.low.view(Table)
    states, payload, _ = coder.encode(ids)
    assert len(asked) == 2
    assert (coder.decode(len(ids), states, payload) == ids).all()


def test_encoder_is_the_librarys():
    encoder, r = Encoder(token_files.default_tokenizer()), random.Random(2)
    parts = ["a", "B", " ", "  ", "'", "s", "re", "ll", "1", "22", "\n", "\t", " ", "é", "²", "!", "’", "　", "漢", "<|endoftext|>", "_", "Σ", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    ids, counts = encoder.encode(pa.array(texts, pa.large_string()))
    for text, found in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert found.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    texts = [(i, f"text {i} " * (i % 5)) for i in range(40)] + [(7, "again"), (50, None), (51, ""), (None, "last"), (20, " ".join(f"q{i}" for i in range(150_000)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted(token_files.token_report(docs, token_files.default_tokenizer(), rows_per_file=10).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in texts if i is not None]) + [None]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    wanted = sorted((i is None, i or 0, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in got) == wanted


def test_mix_of_sources_smaller_than_a_block(spark):
    n, count, key = np.arange(100), np.full(100, 100), np.full(100, 9, np.uint64)
    assert (mixing.unpermute(mixing.permute(n, count, key), count, key) == n).all()
    rows = [(i, "w " * (50 if i < 300 else 150 + i % 7), f"s{i % 320}") for i in range(330)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        source = rows[r.doc_id][2]
        taken[source], target[source] = taken.get(source, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in taken) and min(taken.values()) > 0


def test_notice_in_articles(spark):
    notice = "<p>Please read our terms</p>"
    rows = [(i, f"http://h.example/{i}", f"<article><h2>Summary</h2><p>Page {i} begins</p>{notice}<p>Page {i} ends</p></article>") for i in range(8)]
    rows += [(10 + i, f"http://c.example/{i}", f"<article><p>One</p><p>Copied text</p><p>Two</p><p>Edit {i}</p></article>") for i in range(8)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"Summary Page {i} begins Page {i} ends" for i in range(8)]
    assert all(got[10 + i].startswith("One Copied text ") for i in range(8))


def test_blocks_that_recur_within_one_page(spark):
    def page(i, inner):
        return i, f"https://h.example/{i}", f"<article><h1>Page {i}</h1><p>Text number {i} of its own.</p>{inner}</article>"
    interview = "".join(f"<p>Question {k}?</p><p>Yes.</p>" for k in range(6))
    rows = [page(0, interview), page(1, '<div class="search-results"><p>Found.</p></div><div class="related-work"><p>Others.</p></div><div class="alert"><p>Mind it.</p></div>')]
    rows += [page(i, f"<p>Words {i}.</p><div class='ad'>Buy.</div>") for i in range(2, 9)] + [(9, "https://h.example/9", None), (None, None, "")]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].count("Yes.") == 6 and got[1].endswith("Found. Others. Mind it.")
    assert got[5] == "Page 5 Text number 5 of its own. Words 5." and got[9] == got[None] == ""


def test_template_counts_against_brute_force(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        blocks = [f"<p>{r.choice(['Sign up now', 'All rights', f'own {i} {k}'])}</p>" for k in range(r.randint(1, 6))]
        rows.append((i, f"http://{r.choice('ab')}.example/{i}", "<body><div>" + "".join(blocks) + "</div></body>"))
    rows += rows[:20]
    by_host: dict = {}
    for _, url, page in rows:
        root = pages.parse(page)
        pages.hash_subtrees(root)
        content, marks = pages.main_text(root, frozenset()), pages.candidates(root)
        seen = by_host.setdefault(url[7:16], ({}, set()))
        seen[1].add(content)
        for h, around in marks:
            seen[0].setdefault((h, around is None), set()).add((content, content if around is None else around))
    wanted = {}
    for host, (marks, contents) in by_host.items():
        for (h, _), places in marks.items():
            n = min(len({c for c, _ in places}), len({p for _, p in places}))
            if n >= 5 and n >= 0.3 * len(contents):
                wanted.setdefault(host, set()).add(h)
    got = {x.host: set(x.templates) for x in pages.site_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == wanted and wanted


# ---- memory of executors ---------------------------------------------------------------------

def test_blocks_travel_in_small_batches(spark, table, monkeypatch):
    """Blocks go to Python a few at a time in every pass over them; texts go as the session says."""
    from stackweave.llm import common
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before, stored = spark.conf.get(key), token_files.stored

    def noted(df):
        seen[tuple(df.columns[-2:])] = spark.conf.get(key)
        return stored(df)

    monkeypatch.setattr(token_files, "stored", noted)
    rows = token_files.token_report(table([f"text {i}" for i in range(20)] + [None, ""]), token_files.default_tokenizer()).collect()
    assert len(rows) == 22 and spark.conf.get(key) == before
    assert seen["open", "ids"] == before and seen["checkpoints", "crc"] == seen["part", "whole"] == str(token_files.BATCH)
    blocks = common.stored(spark.range(0, 40, 1, 1).selectExpr("cast(repeat('x', 250000) AS binary) AS ids"))
    with common.batch_bytes(spark, token_files.BATCH):
        sizes = blocks.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 40 and max(r["n"] for r in sizes) <= 9


def test_rows_of_the_driver_need_no_python_workers(spark, table, monkeypatch):
    """Source and frequency tables reach Spark as local rows, nulls and empty tables included."""
    from stackweave.llm import common
    plans, stored = [], common.stored
    monkeypatch.setattr(token_files, "stored", lambda df: plans.append(df._jdf.queryExecution().toString()) or stored(df))
    token_files.token_report(stored(table(["a b", "c"])), token_files.default_tokenizer()).collect()
    docs = stored(table(["one two three", "four five"], extra=False).unionByName(table(["six seven"], extra=False, ids=[9], source=None)))
    for rows in (docs, docs.limit(0)):
        mixed, report = mixing.mixed_documents(rows), mixing.mix_report(rows)
        plans += [mixed._jdf.queryExecution().toString(), report._jdf.queryExecution().toString()]
        assert report.count() == rows.count() and mixed.filter("source IS NULL").count() == (1 if rows is docs else 0)
    assert not any("LogicalRDD" in p for p in plans)
