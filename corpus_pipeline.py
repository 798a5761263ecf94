"""The corpus pipeline: classify, deduplicate exactly and nearly, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept.  All but the last return the columns of documents; the last one returns a
row for each document that the mix takes, with its epoch's copy encoded and
decoded.

Defined results: a null text counts as empty in every stage and stays null in the
rows; the classifier gives it weight 0, of all empty texts one document stays,
it links with nothing and adds no tokens.  A null identifier is a document of its
own (before all others where one of equal texts stays), a null language or source
a leaf of the mix.  Rows that repeat an identifier are judged each by their text;
near copies count them as one document.  Of rows repeated whole one stays.  An empty
table gives an empty table with the same columns.  Further columns pass through all
stages but the last, whatever their names; names that differ in case alone from one
another are an error of Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from versionlog.llm import bpe_codec, exact_dedup, mixing, ngram_join, quality_classifier
from versionlog.llm._io import documents, stored
from versionlog.llm.queries import TOKENIZER, corpus_mix


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier rejects go."""
    return quality_classifier.Resampled(docs, documents(spark, sf_dir, "labels"), carry=True).kept()


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return exact_dedup.Deduplicated(docs).unique()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 the smallest id stays."""
    return ngram_join.Joined(docs, ngram_join.Config(n=5, percent=80)).keep_one()


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, once for each epoch that takes them."""
    return mixing.Mixed(docs, corpus_mix(budget_share=1.0, max_epochs=4)).sample()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return bpe_codec.round_trip(docs.select("doc_id", "text"), TOKENIZER).drop("text")


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix),
    ("bpe_codec", encode),
]

#: SQL can express neither the classifier nor the encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
