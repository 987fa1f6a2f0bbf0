"""Query of suffix-array dedup. No SQL: tested against brute force."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rivulet.llm import repeats
from rivulet.llm.common import table, utf8

FIELDS = [*(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]


def _digest(text: str | None, spans: list[dict]) -> tuple:
    x = utf8(text)
    return len(x), sum(s["stop"] - s["start"] for s in spans), len(spans), hashlib.sha256(repeats.rest(x, spans)).hexdigest()


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.repeats(table(spark, sf_dir, "documents", "doc_id", "text"), fields=FIELDS, answer=_digest)
    return out.select("doc_id", *(f.name for f in FIELDS))


QUERIES = {"op3_repeats": op3_repeats}
