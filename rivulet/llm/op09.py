"""Query of language-model scoring. No SQL: the base is tested against counting, the model on held-out texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import maxent
from rivulet.llm.common import remainder, table


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents", "doc_id", "text"), remainder("doc_id", 7) == 2)


QUERIES = {"op9_language_model": op9_language_model}
