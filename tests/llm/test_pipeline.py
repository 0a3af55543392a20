"""The pipeline on a small corpus whose bad rows are known."""

import random

import pytest

from cytoloom.llm import bpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("sf"))
    syllables = ["ka", "lo", "mi", "ne", "ru", "so", "ta", "vi", "po", "du"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(4)]
    docs, kinds, labels = [], {}, []
    for i in range(500):
        kind, t = "clean", text(rng.randint(30, 90))
        if i % 7 == 0:
            kind, words = "toxic", t.split()
            for k in range(0, len(words), 6):
                words[k] = "grumblork" + rng.choice(["", "s", "ed"])
            t = " ".join(words)
        elif i % 11 == 0:
            kind, t = "leak", t + " " + items[i % 4] + " " + text(10)
        elif i % 13 == 0:
            kind, t = "secret", t + " password=abcd1234efgh " + text(5)
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    for j in range(40):
        source = docs[j * 9 + 1]
        words = source[1].split()
        if j % 2:
            words[-1] = word()
        docs.append((1000 + j, " ".join(words), "en", "s0", len(source[1])))
        kinds[1000 + j] = f"copy of {source[0]}"
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d[0]: d[1] for d in docs}, kinds


def test_each_stage_does_its_part_and_keeps_clean_rows(spark, folder):
    path, texts, kinds = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            toxic = {i for i, k in kinds.items() if k == "toxic" or (k.startswith("copy") and kinds[int(k.split()[-1])] == "toxic")}
            assert gone == toxic
        elif name == "near_copies":
            assert gone == {i for i, k in kinds.items() if k.startswith("copy") and i in before}
        elif name == "decontamination":
            assert gone == {i for i, k in kinds.items() if k == "leak" and i in before}
        else:
            assert not gone
            for i, r in after.items():
                if kinds.get(i) == "secret":
                    assert "<SECRET>" in r.text and "abcd1234efgh" not in r.text and r.n_chars == len(r.text)
                else:
                    assert r == before[i]
    assert {2000, 2001} <= set(after)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    codec = bpe.codec()
    assert len(final) == len(after)
    for r in final:
        assert codec.decode(r.ids).decode() == (after[r.doc_id].text or "") and r.n_tokens == len(r.ids) and r.round_trip


def test_run_gives_the_stages_rows(spark, folder):
    path, _, kinds = folder
    rows = corpus_pipeline.run(spark, path).collect()
    want = {i for i, k in kinds.items() if k in ("clean", "secret")} | {2000, 2001}
    assert {r.doc_id for r in rows} == want


def test_stages_of_an_empty_table_and_of_repeated_and_null_rows(spark, folder):
    path, texts, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    some = [(1, texts[1]), (1, texts[1]), (None, texts[1]), (None, None), (50, "w " * 20_000), (51, " "), (51, " ")]
    odd = spark.createDataFrame([(i, t, None, "s", None, "own") for i, t in some], "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), path)
        assert empty.columns == docs.columns and empty.count() == 0, name
        got = stage(spark, odd, path)
        assert got.columns == odd.columns, name
        n = {i: sum(r.doc_id == i for r in got.collect()) for i in (1, None, 50, 51)}
        assert n == {1: 1 if name == "near_copies" else 2, None: 2, 50: 1, 51: 2}, name
    assert corpus_pipeline.tokens(spark, docs.where("false"), path).count() == 0
    assert corpus_pipeline.tokens(spark, odd, path).count() == len(some)
