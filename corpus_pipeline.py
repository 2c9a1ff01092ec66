"""The corpus pipeline: language ID, near-dedup, passage dedup, mixing, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kintrace.llm.bpe import bpe_roundtrip
from kintrace.llm.common import cut, documents, scratch
from kintrace.llm.langid import keep_known, learn
from kintrace.llm.minhash import one_of_each
from kintrace.llm.mixing import mixed_rows
from kintrace.llm.queries import TOKENIZER
from kintrace.llm.suffix import without_repeats


#: Near-duplicates share 80 of 100 shingles here; a pair at that share has no band in common with probability 7e-6.
NEAR_PERCENT, NEAR_BANDS = 80, 30


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters, null and empty texts go.

    Rows that share an id are judged each by its text. Where no row has a
    language to learn from, none is found, and all rows go.
    """
    return keep_known(docs, learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Of equal rows one stays; an id under two texts stays with each text that is
    no near-duplicate; rows without words stay; an empty table stays empty.
    """
    with scratch(spark) as keep:
        return one_of_each(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, keep=keep)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; those of which nothing is left go, null and empty texts stay."""
    return without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are never taken, null sources are one source."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed as little-endian unsigned 32-bit integers, and the digest of the text they decode to; a null text counts as empty."""
    out = bpe_roundtrip(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id", "source"])
    return out.select("doc_id", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixture", mixture), ("encoding", encoding)]

#: Language models, byte-level BPE and transitive links have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, a table in the shared folder between any two; a row per text taken. An empty table gives no rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
