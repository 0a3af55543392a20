"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import hashlib

import pytest

from cytoloom.llm import bpe, decontaminate, hamming, ngram_join, pii, quality, secrets, toxicity, urls, warc
from cytoloom.llm.scratch import new_folder

LONG = "word " * 60_000 + "end"
TEXTS = [(1, "mail me at a.b@c.org or +1 (555) 123-4567"), (2, None), (3, ""), (None, "a text without an id"), (5, LONG), (1, "mail me at a.b@c.org or +1 (555) 123-4567"), (6, "token = abcdefgh12345678"), (7, " \t\n")]
DDL = "doc_id bigint, text string, id string, n int, salt string, label int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, None, 2) for i, t in TEXTS], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def ids(rows):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)


ALL = sorted((i is not None, i or 0) for i, _ in TEXTS)


def test_personal_data(docs, none):
    rows = pii.sanitise(docs).collect()
    assert ids(rows) == ALL
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) == 2 and all([s.kind for s in r.spans] == ["email", "phone"] and r.clean == "mail me at <EMAIL> or <PHONE>" for r in one)
    assert all(r.spans == [] and r.clean == "" for r in rows if r.doc_id in (2, 3))
    assert pii.sanitise(none).count() == 0


def test_disclosing_terms_are_found_and_copies_are_not_evidence(spark):
    rng = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x" for i in range(400)]
    fresh = lambda k: " ".join(rng[(k * 17 + j * 29) % 400] for j in range(8))
    rows = [(i, f"{fresh(i)} zorblax agent.k@secret.org {fresh(i + 50)}") for i in range(30)]
    rows += [(100 + i, f"{fresh(3)} copycat other.q@secret.org {fresh(4)}") for i in range(30)]
    rows += [(200 + i, f"{fresh(i)} {fresh(i + 7)} {fresh(i + 9)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    terms = {r.term: r for r in pii.disclosing_terms(docs).collect()}
    assert set(terms) == {"zorblax"} and terms["zorblax"].action == "remove"
    clean = {r.doc_id: r.clean for r in pii.sanitise(docs).collect()}
    assert "zorblax" not in clean[0] and "<EMAIL>" in clean[0] and "copycat" in clean[100]
    assert clean[200] == rows[60][1]


def test_secrets(docs, none):
    rows = secrets.scan(docs).collect()
    assert ids(rows) == ALL
    assert [[s.kind for s in r.spans] for r in rows if r.doc_id == 6] == [["assign"]]
    kept = secrets.redact(docs, length="n")
    assert kept.columns == docs.columns and ids(kept.collect()) == ALL
    assert {r.text for r in kept.collect() if r.doc_id == 6} == {"<SECRET>"}
    assert [r.n for r in kept.collect() if r.doc_id == 6] == [8] and [r.n for r in kept.collect() if r.doc_id == 2] == [1]
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0


def test_tokens(docs, none):
    rows = bpe.tokenise(docs).collect()
    assert ids(rows) == ALL and all(r.round_trip for r in rows)
    assert all(r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (2, 3))
    assert bpe.tokenise(none).count() == 0


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


def test_toxicity(spark, docs, none):
    nothing = labels_of(spark, [])
    rows = toxicity.score(docs, nothing).collect()
    assert ids(rows) == ALL and {r.score for r in rows} == {0.0}
    some = labels_of(spark, [(1, 1, 1, None), (1, 0, 0, "x"), (5, 1, 0, None), (6, None, None, None), (None, 1, 1, None), (3, 1, 0, None)])
    rows = toxicity.score(docs, some).collect()
    assert ids(rows) == ALL and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, some).count() == 0
    kept = toxicity.keep_ordinary(docs, nothing)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_toxicity_learns_stems_and_leaves_held_out_labels_alone(spark):
    import zlib

    word = lambda k: "".join("bdfgklmnprst"[(k * 7 + j * 5) % 12] + "aeiou"[(k + j * j) % 5] for j in range(3))
    texts, labels = [], []
    for i in range(600):
        words = [word(i * 31 + j) for j in range(40)]
        bad = i % 4 == 0
        if bad:
            words[5], words[20], words[30] = "vexor" + word(i)[:2], "vexor" + word(i + 1)[:3], "vexora"
        texts.append((i, " ".join(words)))
        # a held-out label that lies must not matter
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, 1, int(bad) if not held else int(not bad), None))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = toxicity.score(docs, labels_of(spark, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert right / len(held) > 0.95


def test_quality(spark, docs, none):
    rows = quality.score(docs, labels_of(spark, [])).collect()
    assert ids(rows) == ALL and {r.score for r in rows} == {0.5}
    some = labels_of(spark, [(1, 1, 1, None), (1, 1, 0, "x"), (5, 0, 0, None), (6, None, None, None), (None, 1, 1, None), (3, 1, 0, None)])
    rows = quality.score(docs, some).collect()
    assert ids(rows) == ALL and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(none, some).count() == 0


def test_prior_estimate_is_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(0)
    pos = rng.beta(8, 3, 20_000)
    unl = np.concatenate([rng.beta(8, 3, 14_000), rng.beta(2, 8, 6_000)])
    h = lambda x: np.histogram(x, quality.BINS, (0, 1))[0].astype(float)
    assert abs(quality.estimated_prior(h(pos), h(unl)) - 0.7) < 0.05


def test_a_very_long_payload(spark):
    long = "".join(map(chr, range(0x20, 0x7F))) * 40_000
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", "x")], "page_id bigint, url string, html string")
    folder = new_folder(spark, "test-warc-long")
    files = warc.normalise(warc.write_monolithic(warc.decided(pages), folder + "/a"), folder + "/b")
    got = {r.page_id: r for r in warc.read_records(files, folder, payload=True).collect()}
    assert bytes(got["2"].payload) == long.encode() and (got["1"].record_type, got["1"].refers_to, got["1"].payload_bytes) == ("revisit", "2", len(long))


def test_terms_joined_equal_terms_broadcast(spark, monkeypatch):
    texts = [(i, f"Invoice {i} for Zebulon at zeb{i % 3}@mail.example please" if i % 2 else f"plain words {i}") for i in range(30)]
    rows = spark.createDataFrame([*texts, texts[1], (None, None), (77, ""), (78, "ZEBULON İnvoice 10.0.0.1")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("zebulon", "remove", 0, 1.0), ("invoice", "generalise", 0, 1.0), ("nowhere", "remove", 1, 1.0)], "term string, action string, kind int, share double")
    of = lambda: sorted(map(str, pii.sanitise(rows, terms=terms).collect()))
    want = of()
    assert sum("<EMAIL-CUE>" in x for x in want) >= 15
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert of() == want


def test_archives(spark):
    big, other = "x" * 1500, "é" * 700
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (3, None, None), (4, "", ""), (5, "http://a/\r\nX: y", "small"), (6, "http://a/6", "small"), (None, "http://a/n", big), (7, "u", other), (8, "u", other)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, id string").repartition(3)
    folder = new_folder(spark, "test-warc")
    files = warc.normalise(warc.write_monolithic(warc.decided(pages), folder + "/a"), folder + "/b")
    got = warc.read_records(files, folder, payload=True).collect()
    key = lambda r: (r.page_id or "", r.record_type, r.refers_to or "")
    assert sorted(map(key, got)) == sorted([("1", "revisit", "2"), ("2", "response", ""), ("2", "response", ""), ("3", "response", ""), ("4", "response", ""), ("5", "response", ""), ("6", "response", ""), ("", "revisit", "2"), ("7", "revisit", "8"), ("8", "response", "")])
    text = {r[0]: r[2] for r in rows}
    for r in got:
        whole = (text[int(r.page_id)] if r.page_id else big) or ""
        assert r.payload_bytes == len(whole.encode()) and r.payload_digest == hashlib.sha1(whole.encode()).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == whole.encode()
    again = warc.normalise(files.select("path"), folder + "/c")
    assert again.agg({"records": "sum"}).first()[0] == len(rows)
    empty = warc.write_monolithic(warc.decided(pages.where("page_id = 99")), folder + "/d")
    assert warc.read_records(warc.normalise(empty, folder + "/e"), folder).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.Example.COM/en/742?x"), (2, None), (3, "no scheme"), (4, "http://"), (5, "https://x.net"), (6, "https://x.net/de/1#f"), (6, "https://x.net/de/1#f"), (None, "ftp://example.net/de/8"), (8, "http://com/en/"), (9, "http://telecom/en/"), (10, "a://b.org/es/?q=://c.com/en/"), (11, "http://" + "a." * 3000 + "com/en/" + "y" * 50_000)]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")
    got = sorted(((r.page_id or 0, r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark)).collect()), key=str)
    want = [(1, "example.com/en/7", "allow"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, "net/de/", "allow"), (6, "net/de/", "allow"), (0, "example.net/de/8", "block"), (8, "com/en/", "block"), (9, None, "allow"), (10, "org/es/", "block"), (11, "com/en/", "block")]
    assert got == sorted(want, key=str)
    assert urls.judge(pages.where("page_id = 99"), urls.rule_table(spark)).count() == 0
    assert urls.judge(pages, urls.rule_table(spark).where("false")).count() == len(rows)


@pytest.mark.parametrize("shard", [65_536, 16])
def test_top_k(spark, shard, monkeypatch):
    import random

    monkeypatch.setattr(hamming, "SHARD_ENTRIES", shard)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(7, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 64), (None, rows[1][1]), (2050, [1.0, -1.0]), (2051, [1.0, 1.0])]
    t = spark.createDataFrame([(*r, "z") for r in rows], "vec_id bigint, embedding array<double>, code string")
    asked = t.where("vec_id % 50 = 0")
    got = {}
    for r in hamming.top_k(t, asked, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbour_id))
    sign = {i: [x > 0 for x in e] for i, e in rows if i is not None and e and all(x is not None and x == x for x in e)}
    for q in (i for i in sign if i % 50 == 0):
        best = sorted((sum(a != b for a, b in zip(sign[q], c)), i) for i, c in sign.items() if i != q and len(c) == len(sign[q]))[:10]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(best)]
    assert hamming.top_k(t.where("false"), asked).count() == 0


def test_ngram_groups(spark, docs, none):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(docs).collect()}
    assert rows == {(1, 5, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (5, 2, 5), (6, 1, 6), (7, 0, 7)}
    assert ngram_join.groups(none).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "Tom buys 12 apples and gives Anna 3 kg of pears while Tom keeps 12 for later today", "q"), (2, None, "q"), (3, "", "q"), (4, "short item here", "q")], "item_id bigint, text string, doc_id string")
    bad = [
        (10, "Intro text. then Bob buys 7 apples and gives Mary 5 lb of pears while Bob keeps 7 for later today and more"),
        (11, "Intro text. then Bob buys 7 apples and gives Mary 5 lb of pears while Carl keeps 9 for later today and more"),
        (12, "some Tom buys 12 apples and gives Anna 3 kg of pears while Tom keeps 12 for later today"),
        (13, "this is a short item here indeed"),
        (14, "wholly different words in every place of this text so nothing is found at all"),
        (None, "some Tom buys 12 apples and gives Anna 3 kg of pears while Tom keeps 12 for later today"),
    ]
    texts = spark.createDataFrame([(*r, 0) for r in bad + [bad[2]]], "doc_id bigint, text string, item_id int").unionByName(docs.select("doc_id", "text", docs["n"].alias("item_id")))
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find(texts, items).collect()}
    assert set(found) == {(10, 1), (12, 1), (13, 4), (None, 1)}
    assert found[10, 1].changed_slots > 0 and found[12, 1].changed_slots == 0
    kept = decontaminate.drop_found(texts, items)
    assert kept.columns == texts.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [11, 14, *[i for i, _ in TEXTS]]))
    assert decontaminate.find(none, items).count() == 0
    assert decontaminate.find(texts, items.where("false")).count() == 0 and decontaminate.drop_found(texts, items.where("false")).count() == texts.count()
