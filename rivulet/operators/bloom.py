"""Bloom filters: sizing, and an explicit filter as a table of 64-bit words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BIT = "shiftleft(1L, cast(_at % 64 AS int))"


def bits(n: Column, p: Column) -> Column:
    ln2 = math.log(2)
    return F.floor(n * -F.log(p) / F.lit(ln2 * ln2)).cast("long")


def hashes(m: Column, n: Column) -> Column:
    return F.floor(F.try_divide(m, n)).cast("long")


def best_hashes(m: Column, n: Column) -> Column:
    return F.round(F.try_divide(m, n) * math.log(2)).cast("long")


def size(n: int, p: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at rate p."""
    m = max(64, math.floor(n * -math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(n, 1) * math.log(2)))


def _positions(key: Column, m: int, k: int) -> Column:
    return F.array_distinct(F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(m)) for i in range(k))))


def build(keys: DataFrame, m: int, k: int, key: str = "k") -> DataFrame:
    """The filter's words (word, mask): OR-ed before the shuffle, so mergeable and free of hot keys."""
    at = keys.select(F.explode(_positions(F.col(key), m, k)).alias("_at"))
    word = F.floor(F.col("_at") / 64).cast("long")
    return at.groupBy(word.alias("word")).agg(F.bit_or(F.expr(_BIT)).alias("mask"))


def might_contain(probes: DataFrame, filter_words: DataFrame, m: int, k: int, key: str = "k") -> DataFrame:
    """Distinct probe keys with ``maybe``: false only if the filter proves absence."""
    want = probes.select(key).distinct().select(key, F.explode(_positions(F.col(key), m, k)).alias("_at"))
    want = want.withColumn("word", F.floor(F.col("_at") / 64).cast("long"))
    seen = want.join(filter_words, "word", "left")
    hit = F.coalesce(F.col("mask").bitwiseAND(F.expr(_BIT)) != 0, F.lit(False))
    return seen.groupBy(key).agg(F.min(hit).alias("maybe"))
