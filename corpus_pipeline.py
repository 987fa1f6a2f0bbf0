"""A training corpus from raw documents: toxicity, near copies, repeated passages, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.
No SQL expresses the stages: tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.functions.session import stored
from rivulet.llm import bpe, jaccard, mixing, op01, op07, repeats, toxicity
from rivulet.llm.common import table, utf8

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    docs = _documents(docs)
    lexicon = op07.learned(spark, sf_dir, docs)
    return toxicity.score(docs, lexicon, into="_score").where(F.col("_score") < op07.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that with the smallest id, null ids last; of equal rows one.

    Rows are told apart by a number of their own, so null and repeated ids keep no row but the group's first. Texts
    without shingles are near copies of nothing.
    """
    docs = stored(_documents(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard.join(docs, size=5, percent=80, key="_row").select("_row", "component_id")
    ids = docs.select("_row", F.col("doc_id").isNull().alias("_none"), "doc_id")
    kept = groups.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("_none", "doc_id", "_row")).alias("_first"))
    out = docs.join(kept.select(F.col("_first._row").alias("_row")), "_row", "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("n_chars")
    return out.withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that stood earlier; characters cut in part are dropped."""
    docs = _documents(docs)

    def cut(text: str | None, spans: list[dict]) -> tuple:
        kept = None if text is None else repeats.rest(utf8(text), spans).decode("utf-8", "ignore")
        return kept, None if kept is None else len(kept)

    return repeats.repeats(docs, fields=[docs.schema["text"], docs.schema["n_chars"]], answer=cut).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target weight asks for."""
    sized = _documents(docs).withColumn("size", mixing.size_of(F.col("text")))
    mixed = mixing.mix(sized)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), op01.tokenizer_path())
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("repeats", drop_repeats), ("mixing", mix_sources), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
