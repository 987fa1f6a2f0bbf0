"""Query of the n-gram Jaccard join, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import jaccard
from rivulet.llm.common import table


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text"), size=4, percent=85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
 ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) END AS sh, len(ws) AS nw FROM w),
e AS (SELECT doc_id, CASE WHEN nw < 4 THEN 'short ' ELSE 'full ' END || unnest(sh) AS x FROM s),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r(node, hit) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.b FROM r JOIN l ON r.hit = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.hit) AS component_id FROM n JOIN r ON n.doc_id = r.node GROUP BY ALL
"""

QUERIES = {"op6_jaccard": op6_jaccard}
ORACLES = {"op6_jaccard": SQL}
