"""Query of mixing sources to target weights, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.session import stored
from rivulet.llm import mixing
from rivulet.llm.common import table


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = stored(docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size")), "sizes")
    out = mixing.mix(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ([3.0::DOUBLE, 1.0, 2.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * 2.0::DOUBLE AS cap FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rn FROM weighted),
below AS (SELECT *, min(CASE WHEN lv * w <= cap THEN rn END) OVER () AS "at" FROM levels),
final AS (SELECT *, max(CASE WHEN rn = "at" THEN lv END) OVER () AS fl FROM below),
goal AS (SELECT source, source_size, least(cap, coalesce(fl, 'inf'::DOUBLE) * w) AS target FROM final),
goal2 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS f FROM goal),
goal3 AS (SELECT *, floor(f) AS sure, f - floor(f) AS p, target - floor(f) * source_size AS rest FROM goal2),
drawn AS (SELECT s.*, g.source_size, g.target, g.sure, g.p, g.rest,
 (CAST(('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
 FROM sized s JOIN goal3 g ON s.source IS NOT DISTINCT FROM g.source),
ranked AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ranked)
SELECT doc_id, size, source_size, target, CAST((sure + CASE WHEN p > 0 AND rest > 0 AND start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed
"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": SQL}
