"""A training corpus from raw documents, in five written stages.

Toxic documents go; of each group of near copies (five-word shingles, Jaccard 0.8 or more) the one with
the least id stays; documents that hold a benchmark item go; secrets are replaced in what is left; the
rest is tokenised and decoded again. Every stage works on all rows the one before it kept.

In every stage but the last, all columns of the input stay, whatever their names, and null values in them
pass; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoloom.llm.bpe import tokenise
from cytoloom.llm.decontaminate import drop_found
from cytoloom.llm.ngram_join import Shape, keep_one
from cytoloom.llm.scratch import discard, stored
from cytoloom.llm.secrets import redact
from cytoloom.llm.toxicity import keep_ordinary, train

NEAR = Shape(words=5, percent=80)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows not called toxic. A null or empty text has no evidence and stays where unlabelled text does; a
    null id is scored but not learned from; repeated rows go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_ordinary(docs, labels, scorer=train(docs, labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts, that with the least id. Null, empty and wordless texts are like
    nothing and all stay, and so do rows with a null id; of rows that share id and text one stays."""
    return keep_one(docs, shape=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item. Null and wordless texts hold none; a row with a null id and
    repeated rows go like any other; an empty benchmark removes nothing."""
    return drop_found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced and ``n_chars`` following where a text changed. A null text stays null;
    repeated rows all stay."""
    return redact(docs, length="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and digests of the ids and of the decoded bytes. A null text counts
    as empty; null ids and repeated rows each give a row."""
    return tokenise(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: Learned scores and byte pairs have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
            # what the stage read is not read again once its result is written
            discard(before)
    return docs
