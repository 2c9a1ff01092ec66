"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_roundtrip
from .chat import op2_chat
from .common import documents, shared_dir
from .hnsw import op4_embedding_dedup
from .langid import op9_langid
from .minhash import op7_minhash
from .mixing import OP3_SQL, op3_mixing
from .passages import op8_passages
from .quality import op6_quality
from .suffix import op10_suffix_dedup
from .tokenfiles import read_tokens, write_tokens

TOKENIZER = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_roundtrip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), keep=["doc_id"])
    return out.select(
        "doc_id",
        (F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, folder)


QUERIES = {"op1_bpe": op1_bpe, "op2_chat": op2_chat, "op3_mixing": op3_mixing, "op4_embedding_dedup": op4_embedding_dedup, "op5_token_files": op5_token_files, "op6_quality": op6_quality, "op7_minhash": op7_minhash, "op8_passages": op8_passages, "op9_langid": op9_langid, "op10_suffix_dedup": op10_suffix_dedup}
ORACLES = {"op3_mixing": OP3_SQL}
