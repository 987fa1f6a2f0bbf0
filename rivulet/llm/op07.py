"""Query of toxicity. No SQL: held-out accuracy is tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import toxicity
from rivulet.llm.common import remainder, table

THRESHOLD = 0.7


def learned(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Lexicon:
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(remainder("doc_id", 3) != 1)
    return toxicity.fit(docs, labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = learned(spark, sf_dir, docs)
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
