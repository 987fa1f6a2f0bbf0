"""Size tiers of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.schema import Config


def fits(size: Column, average: Column, cfg: Config = Config()) -> Column:
    """Whether a run belongs to a tier with this average size: near it, or both below the least size."""
    near = (average * cfg.bucket_low < size) & (size < F.floor(average * cfg.bucket_high))
    return near | ((size < cfg.min_run_bytes) & (average < cfg.min_run_bytes))


def fits_value(size: int, average: int, cfg: Config) -> bool:
    near = average * cfg.bucket_low < size < int(average * cfg.bucket_high)
    return near or (size < cfg.min_run_bytes and average < cfg.min_run_bytes)


def choose_tier(tiers: dict[str, list[int]], size: int, cfg: Config) -> str | None:
    """The first tier, in order of creation, that takes a run of this size. The manifest is small: a plain loop."""
    for tier, sizes in tiers.items():
        if sizes and fits_value(size, sum(sizes) // len(sizes), cfg):
            return tier
    return None


def averages(runs: DataFrame, tier: str = "tier_id", size: str = "size_bytes") -> DataFrame:
    return runs.groupBy(tier).agg(F.floor(F.avg(size)).cast("long").alias("avg_size"), F.count("*").alias("n_runs"))


def to_compact(runs: DataFrame, order: list[Column], tier: str = "tier_id", cfg: Config = Config()) -> DataFrame:
    """Runs that a compaction takes: of each tier with enough of them, the first ones in ``order``."""
    w = Window.partitionBy(tier)
    ranked = runs.withColumn("_n", F.count("*").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where((F.col("_n") >= cfg.min_threshold) & (F.col("_rank") <= cfg.max_threshold)).drop("_n", "_rank")
