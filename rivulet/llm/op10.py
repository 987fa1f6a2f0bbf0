"""Query of quality rules, with DataFrame functions only, and its SQL.

The SQL takes exact quantiles; sketches of groups below their own size (``quality.SKETCH_K``) are exact too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import quality
from rivulet.llm.common import table


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    out = quality.rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Measure, sides of its fence, least width: as in quality._measures.
_SIDES = {"word_length": ("low", "high", 0.5), "symbols": ("high", 0.1), "dup_lines": ("high", 0.02), "repeats": ("high", 0.2)}


def _fences(prefix: str) -> str:
    out = []
    for m, (*sides, least) in _SIDES.items():
        q1, q3 = f"quantile_disc({m}, 0.25)", f"quantile_disc({m}, 0.75)"
        width = f"greatest(({q3} - {q1}) * {quality.REACH}::DOUBLE, {least}::DOUBLE)"
        out += [f"{q1} - {width} AS {prefix}{m}_low"] if "low" in sides else []
        out += [f"{q3} + {width} AS {prefix}{m}_high"]
    return ", ".join(out)


def _inside() -> str:
    out = ["NOT base_failed"]
    for m, (*sides, _) in _SIDES.items():
        for side in sides:
            out.append(f"coalesce({m} {'>=' if side == 'low' else '<='} coalesce(own_{m}_{side}, all_{m}_{side}), TRUE)")
    return " AND ".join(out)


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents),
l AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls, t FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
g AS (SELECT *, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, CASE WHEN w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM r),
n AS (SELECT doc_id, CAST(sum(covered) AS BIGINT) AS n_repeat_words FROM c GROUP BY doc_id),
k AS (SELECT doc_id, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM l),
f AS (SELECT d.doc_id, lang, source, CAST(len(l.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(k.ls) - len(list_distinct(k.ls)) AS BIGINT) AS n_dup_lines,
 coalesce(n.n_repeat_words, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)),
m AS (SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS word_length, n_symbols::DOUBLE / greatest(n_words, 1) AS symbols, n_dup_lines::DOUBLE / greatest(n_words, 1) AS dup_lines,
 n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeats, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
own AS (SELECT lang AS gl, source AS gs, {_fences("own_")} FROM m WHERE NOT base_failed GROUP BY lang, source HAVING count(*) >= {quality.LEAST}),
wide AS (SELECT lang AS wl, {_fences("all_")} FROM m WHERE NOT base_failed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {_inside()} AS kept
FROM m LEFT JOIN own ON lang IS NOT DISTINCT FROM gl AND source IS NOT DISTINCT FROM gs LEFT JOIN wide ON lang IS NOT DISTINCT FROM wl
"""

QUERIES = {"op10_quality": op10_quality}
ORACLES = {"op10_quality": SQL}
