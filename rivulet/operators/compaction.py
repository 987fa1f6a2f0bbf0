"""Merging runs: newest version per key, then the rules for expired records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.schema import Config, expired
from rivulet.operators.resolve import RECENCY, latest


def surviving(entries: DataFrame, as_of: Column, cfg: Config, drop_tombstones: bool = True) -> DataFrame:
    """Without expired tombstones and, if time to live is on, without expired entries.

    ``drop_tombstones`` must be off if a run outside the merge may hold an older version of a key.
    """
    dead = F.col("is_tombstone") & expired(F.col("created_at"), cfg.tombstone_ttl_ms, as_of) if drop_tombstones else F.lit(False)
    if cfg.enable_ttl:
        stale = ~F.col("is_tombstone") & expired(F.col("created_at"), cfg.entry_ttl_ms, as_of)
        dead = dead | stale if drop_tombstones else stale
    return entries.where(~dead)


def merge(entries: DataFrame, as_of: Column, cfg: Config = Config(), key: str = "k", recency: tuple[str, ...] = RECENCY, drop_tombstones: bool = True) -> DataFrame:
    """The merged run of all ``entries``, in any number of runs."""
    return surviving(latest(entries, key, recency), as_of, cfg, drop_tombstones)
