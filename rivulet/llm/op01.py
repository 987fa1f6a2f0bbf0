"""Query of BPE encoding and decoding. No SQL: the tests hold it against the tokenizers library."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rivulet.llm import bpe
from rivulet.llm.common import table

FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _digest(codec: bpe.BpeCodec, ids, decoded: bytes) -> tuple:
    return len(ids), hashlib.sha256(codec.decimal_text(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = bpe.round_trip(docs, tokenizer_path(), FIELDS, _digest)
    return out.select("doc_id", *(f.name for f in FIELDS))


QUERIES = {"op1_bpe": op1_bpe}
