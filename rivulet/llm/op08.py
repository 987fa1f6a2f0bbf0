"""Query of embedding near-duplicates. No SQL: recall against brute force is tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import embeddings
from rivulet.llm.common import table


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op8_embeddings": op8_embeddings}
