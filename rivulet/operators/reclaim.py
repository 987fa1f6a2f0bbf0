"""Which log records are still valid, and taking back the space of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.resolve import latest


def classify(chunk: DataFrame, log: DataFrame) -> DataFrame:
    """Appends ``valid``: the record is its key's newest and no tombstone. Only keys of the chunk are resolved."""
    newest = latest(log.join(chunk.select("k").distinct(), "k", "left_semi")).select("k", F.col("voff").alias("_newest"), F.col("is_tombstone").alias("_gone"))
    return chunk.join(newest, "k", "left").withColumn("valid", F.coalesce((F.col("voff") == F.col("_newest")) & ~F.col("_gone"), F.lit(False))).drop("_newest", "_gone")


def keep(chunk: DataFrame, live: DataFrame) -> DataFrame:
    """Records to write again, as they were: times and order unchanged."""
    return chunk.join(live.select("k", "voff"), ["k", "voff"], "left_semi")


def drop(chunk: DataFrame, live: DataFrame) -> DataFrame:
    return chunk.join(live.select("k", "voff"), ["k", "voff"], "left_anti")


def amplification(log: DataFrame, live: DataFrame) -> DataFrame:
    """Bytes written against bytes still live."""
    total = log.agg(F.count("*").alias("n_records"), F.sum("rec_size").alias("total_bytes"))
    alive = live.agg(F.count("*").alias("n_live"), F.sum("rec_size").alias("live_bytes"))
    return total.withColumns({c: alive.select(c).scalar() for c in ("n_live", "live_bytes")})
