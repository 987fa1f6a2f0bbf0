"""Query of language identification. No SQL: held-out accuracy and a brute-force form are tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import language
from rivulet.llm.common import remainder, table


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    known = language.profiles(docs.where(remainder("doc_id", 3) != 1))
    return language.identify(docs.select("doc_id", "text"), known).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
