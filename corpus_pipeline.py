"""A training-data pipeline: language ID, near-duplicate removal, secret masking, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meridian.llm import bpe, jaccard_join, langid, mixing, secret_scan
from meridian.llm.common import drop, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the network finds a language; the others go: null text, no letter, or scored near chance. Null
    ids, nulls in other columns and repeated rows stay as they are; without labelled rows all texts with a letter stay; an
    empty table stays empty."""
    model = langid.calibrate(langid.train_on_folds(docs), langid.labelled(docs, held_out=True))
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by the n-gram Jaccard join. Rows that repeat an id and
    text come down to one, rows of null id take part; texts without words are linked with nothing and stay."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars set to the new lengths; every row stays, repeated ones and those of null
    text or id too."""
    return secret_scan.mask_documents(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it. A null source is one of its own; null and empty texts
    have no words and go by their source's rate; repeated rows draw alike; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row per repetition. Null text counts as empty; null ids stay."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained network, zstandard and a tokenizer can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's table is deleted once the next one is written, the last but one
    stays, as the result is read from it."""
    given = docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir))
        if docs is not given:
            drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
