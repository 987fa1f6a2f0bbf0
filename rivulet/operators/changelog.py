"""The log: record sizes, offsets, replay and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.schema import RECORD_OVERHEAD


def record_size(k: str = "k", v: str = "v") -> Column:
    return (F.coalesce(F.octet_length(k), F.lit(0)) + F.coalesce(F.octet_length(v), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def prefix_sum(df: DataFrame, size: Column, into: str, order: str = "seq", width: int = 1 << 20, base: int = 0, by: str | None = None) -> DataFrame:
    """The sum of ``size`` over all rows (with equal ``by``) before each row, in two levels.

    Rows are cut into blocks of ``width`` consecutive values of ``order`` (a long); block totals, one row per
    block, get their running sum first, so no task ever holds more than a block.
    """
    own = [by] if by else []
    blocks = df.withColumn("_size", size.cast("long")).withColumn("_block", F.floor(F.col(order) / width))
    totals = blocks.groupBy(*own, "_block").agg(F.sum("_size").alias("_total"))
    before = (Window.partitionBy(by) if by else Window).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*own, "_block", (F.coalesce(F.sum("_total").over(before), F.lit(0)) + base).alias("_start"))
    inner = Window.partitionBy(*own, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_inner", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
        .join(starts, [*own, "_block"])
        .withColumn(into, (F.col("_start") + F.col("_inner")).cast("long"))
        .drop("_block", "_size", "_inner", "_start")
    )


def with_offsets(log: DataFrame, base: int = 0, by: str | None = None) -> DataFrame:
    """Appends rec_size and voff, the place of each record in one continuous log (for each value of ``by``)."""
    return prefix_sum(log.withColumn("rec_size", record_size()), F.col("rec_size"), "voff", base=base, by=by)


def replay(log: DataFrame, head: int) -> DataFrame:
    """Records after the one at ``head``."""
    return log.where(F.col("voff") > head)


def chunk(log: DataFrame, tail: int, size: int) -> DataFrame:
    """Records that begin within ``size`` bytes from ``tail``; the one that crosses the end is included."""
    return log.where((F.col("voff") >= tail) & (F.col("voff") < tail + size))
