"""Query of licence scans, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import licenses
from rivulet.llm.common import table


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "canonical_sha256", "license")


def _sql() -> str:
    x = f"translate(text, '{licenses.UPPER}', '{licenses.LOWER}')"
    for pattern, other in [(licenses.COPYRIGHT_LINE, "\n"), *licenses.SPELLINGS, (licenses.OTHER, " "), (r"[ \n]+", " ")]:
        to = "chr(10)" if other == "\n" else f"'{other}'"
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    rows = ", ".join(f"('{d}', '{n}')" for d, n in sorted(licenses.digests().items()))
    return f"WITH d AS (SELECT doc_id, sha256(trim({x}, ' ')) AS canonical_sha256 FROM documents), k(canonical_sha256, license) AS (VALUES {rows}) SELECT doc_id, canonical_sha256, license FROM d LEFT JOIN k USING (canonical_sha256)"


QUERIES = {"op4_licenses": op4_licenses}
ORACLES = {"op4_licenses": _sql()}
