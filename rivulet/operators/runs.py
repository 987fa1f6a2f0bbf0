"""Memtables, sorted runs, their summaries, and finding runs and blocks by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.schema import BLOCK_BYTES, MEMTABLE_OVERHEAD, RECORD_OVERHEAD
from rivulet.operators.changelog import prefix_sum


def memtables(log: DataFrame, capacity: int) -> DataFrame:
    """Appends memtable_id: consecutive records share one until their log bytes fill ``capacity``.

    Cuts fall at multiples of the capacity; an exact restart of the count at each overflow would be one sequential scan.
    """
    return log.withColumn("memtable_id", F.floor(F.col("voff") / capacity).cast("long"))


def memtable_size(log: DataFrame) -> DataFrame:
    """Bytes a memtable counts: key and fixed fields of every insert, overwrites included."""
    return log.groupBy("memtable_id").agg(
        F.sum(F.octet_length("k") + MEMTABLE_OVERHEAD).cast("long").alias("size_bytes"),
        F.countDistinct("k").alias("n_keys"),
        F.max("voff").alias("most_recent_offset"),
    )


def summarise(entries: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run: key range, entries, tombstones, bytes."""
    return entries.groupBy(run).agg(
        F.min("k").alias("min_k"),
        F.max("k").alias("max_k"),
        F.count("*").alias("n_entries"),
        F.sum(F.col("is_tombstone").cast("long")).alias("n_tombstones"),
        F.sum(F.octet_length("k") + RECORD_OVERHEAD).cast("long").alias("size_bytes"),
    )


def prune(summary: DataFrame, key: Column) -> DataFrame:
    """Runs whose key range holds the key."""
    return summary.where((F.col("min_k") <= key) & (F.col("max_k") >= key))


def overlap(summary: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs whose key range meets the interval."""
    return summary.where((F.col("max_k") >= low) & (F.col("min_k") <= high))


#: Rows of a summary that are sent to every task; beyond that, runs and keys meet by the key's first byte.
FEW = 50_000


def candidates(probes: DataFrame, summary: DataFrame, key: str = "k") -> DataFrame:
    """Probe keys with each run that may hold them."""
    inside = (F.col(key) >= F.col("min_k")) & (F.col(key) <= F.col("max_k"))
    if summary.count() <= FEW:
        return probes.join(F.broadcast(summary), inside)
    first = lambda c: F.coalesce(F.conv(F.hex(F.substring(F.col(c).cast("binary"), 1, 1)), 16, 10).cast("int"), F.lit(0))
    spread = summary.withColumn("_first", F.explode(F.sequence(first("min_k"), first("max_k"))))  # 256 rows a run at most
    return probes.withColumn("_first", first(key)).join(spread, "_first").where(inside).drop("_first")


def blocks(entries: DataFrame, order: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Appends block_id: entries in key order, cut where their running size passes a block's end.

    ``order`` is the entry's rank in key order, a long.
    """
    out = prefix_sum(entries, F.octet_length("k") + RECORD_OVERHEAD, "_at", order=order)
    return out.withColumn("block_id", F.floor(F.col("_at") / block_bytes).cast("long")).drop("_at")


def block_index(entries: DataFrame) -> DataFrame:
    """The sparse index: the last key of each block."""
    return entries.groupBy("block_id").agg(F.max("k").alias("last_key"), F.count("*").alias("n_entries"))


def _placed(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Range partitions of the key, numbered in ``_part``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id())


def index_lookup(probes: DataFrame, index: DataFrame, key: str = "k", partitions: int | None = None) -> DataFrame:
    """For each probe the first block whose last key is not smaller; null beyond the last block.

    Probes and index are sorted together by key ranges; each probe takes the next block of its range, or else the first
    block of the ranges after it.
    """
    none = F.lit(None).cast(index.schema["block_id"].dataType)
    both = probes.select(F.col(key).alias("_k"), none.alias("block_id"), F.lit(True).alias("_asked")).distinct()
    placed = _placed(both.unionByName(index.select(F.col("last_key").alias("_k"), "block_id", F.lit(False).alias("_asked"))), "_k", partitions)
    here = Window.partitionBy("_part").orderBy("_k", F.desc("_asked")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    firsts = placed.groupBy("_part").agg(F.min("block_id").alias("_first")).select("_part", F.min("_first").over(later).alias("_later"))  # a row for each partition
    found = placed.withColumn("_next", F.min("block_id").over(here)).where("_asked").join(F.broadcast(firsts), "_part")
    return found.select(F.col("_k").alias(key), F.coalesce("_next", "_later").alias("block_id"))


def key_ranked(df: DataFrame, into: str = "ord", partitions: int | None = None) -> DataFrame:
    """Appends the rank of each row in key order (keys distinct): range partitions, each counted once, then numbered."""
    placed = _placed(df, "k", partitions)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("k")
    return placed.join(F.broadcast(starts), "_part").withColumn(into, F.col("_start") + F.row_number().over(within) - 1).drop("_part", "_start")
