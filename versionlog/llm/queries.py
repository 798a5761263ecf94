"""The registered queries, one for each operator, over the whole of their tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, exact_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, substring_dedup, token_counts, token_output
from ._io import documents, put, shared_dir, text_of

#: Where the vocabulary files are; they are never copied.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048
END_ID = 2
#: Sources by number: the domains of the mix, in turn.
DOMAINS = ("web", "books", "code", "forums")
WEIGHTS = {
    "domain": {"web": 4, "books": 3, "code": 2, "forums": 1},
    "language": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 2},
}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, TOKENIZER).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.Deduplicated(documents(spark, sf_dir).select("doc_id", "text")).decisions()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find_pii(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER).drop("text")


def corpus_mix(**more) -> mixing.Mix:
    number = F.coalesce(F.regexp_extract("source", "[0-9]+", 0).try_cast("int"), F.lit(0)) % len(DOMAINS)
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), number + 1)
    return mixing.Mix(domain=domain, language=F.col("lang"), source=F.col("source"), weights=WEIGHTS, **more)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mixing.Mixed(docs, corpus_mix(budget_share=0.8, max_epochs=3)).decisions()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.Passages(documents(spark, sf_dir).select("doc_id", "text")).decisions()


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-output")
    token_output.write_tokens(documents(spark, sf_dir), TOKENIZER, path, END_ID)
    return token_output.read_documents(spark, path)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return ngram_join.Joined(docs, ngram_join.Config(n=4, percent=85)).decisions()


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_classifier.Resampled(docs, documents(spark, sf_dir, "labels")).decisions()


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_output": op8_token_output,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_classifier": op10_quality_classifier,
}
