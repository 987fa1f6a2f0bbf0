"""The stages one after another, each against a plain form of itself."""

import re
from collections import Counter

import corpus_pipeline as cp
from rivulet.functions.session import stored
from rivulet.llm import op01, op07, toxicity
from tests.llm.test_operators import brute_components, library


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    everything = docs.collect()
    tables = []
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, small), f"test-{name}")
        tables.append(docs)
    for t in tables[:-1]:
        assert t.columns == cp.COLUMNS
    clean, once, cut, mixed, ids = ([*t.collect()] for t in tables)
    lexicon = op07.learned(spark, small, spark.read.parquet(f"{small}/documents.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(spark.read.parquet(f"{small}/documents.parquet"), lexicon).where(f"score >= {op07.THRESHOLD}").collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in everything} - bad
    first = {i for i, _, c in brute_components([tuple(r) for r in clean], 5, 80) if i == c}
    assert sorted(r["doc_id"] for r in once) == sorted(first)
    seen = set()
    texts = {r["doc_id"]: r["text"] for r in cut}
    for r in sorted(once, key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = b"".join(b[m.start() : m.end()] for m in re.finditer(b"\0+", bytes(cover)))
        assert texts[r["doc_id"]] == (None if r["text"] is None else kept.decode(errors="ignore"))
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(texts) and max(copies.values()) <= 2
    t = library()
    assert Counter(r["doc_id"] for r in ids) == copies
    for r in ids[:200]:
        assert r["ids"] == t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
    assert op01.tokenizer_path()


def test_stages_take_empty_tables_and_odd_rows(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", None, 11), (3, "same words here again and more", "en", "s", 30), (3, "same words here again and more", "en", "s", 30)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            docs = stored(stage(spark, docs, small), f"odd-{name}")
        assert docs.count() == 0 if not rows else docs.count() >= 1


def test_near_copies_with_null_and_repeated_ids(spark, small):
    """Rows whose id is null or stands elsewhere too, near copies of a row that stays, go."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join([*words[:-1], "z"]), " ".join(f"v{i}" for i in range(60))
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    texts = [(1, " ".join(words)), (None, near), (None, other), (5, near + " y"), (5, "a text that stands alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in cp.drop_near_copies(spark, docs, small).collect())
    assert got == [(0, other), (1, texts[0][1]), (5, texts[4][1])]
