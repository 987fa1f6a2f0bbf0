"""Which version of a key counts, and reads built upon that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENCY = ("created_at", "seq")


def latest(log: DataFrame, key: str = "k", recency: tuple[str, ...] = RECENCY) -> DataFrame:
    """The newest record per key under the total order ``recency``.

    Ranking by ``row_number() = 1`` lets the planner keep one row per key and task before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in recency))
    return log.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def live(log: DataFrame, key: str = "k", recency: tuple[str, ...] = RECENCY) -> DataFrame:
    """The newest records, without deleted keys."""
    return latest(log, key, recency).where(~F.col("is_tombstone"))


def deleted(log: DataFrame, key: str = "k", recency: tuple[str, ...] = RECENCY) -> DataFrame:
    return latest(log, key, recency).where(F.col("is_tombstone"))


def multi_get(log: DataFrame, probes: DataFrame, key: str = "k") -> DataFrame:
    """One row per distinct probe key with ``found``; only the log rows of these keys are resolved."""
    keys = probes.select(key).distinct()
    hits = live(log.join(keys, key, "left_semi"), key)
    return keys.join(hits.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def range_scan(log: DataFrame, low: Column, high: Column, key: str = "k") -> DataFrame:
    """Live records with low <= key <= high. The bounds reach the file scan."""
    return live(log.where(F.col(key).between(low, high)), key)


def prefix_scan(log: DataFrame, prefix: str, key: str = "k") -> DataFrame:
    return live(log.where(F.col(key).startswith(prefix)), key)


def as_of(log: DataFrame, at: Column, key: str = "k") -> DataFrame:
    """Live records as a reader at time ``at`` saw them."""
    return live(log.where(F.col("created_at") <= at), key)
