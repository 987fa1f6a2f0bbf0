import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rivulet.functions import schema as S
from rivulet.operators import bloom, changelog, compaction, reclaim, resolve, runs, tiering

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(s, k, v, T0 + dt.timedelta(days=d), g) for s, k, v, d, g in rows], "seq long, k string, v string, created_at timestamp, is_tombstone boolean")


def test_latest_by_time_then_sequence(spark):
    df = log(spark, [(1, "a", "1", 0, False), (2, "a", "2", 0, False), (3, "b", "1", 5, False), (4, "b", None, 4, True), (5, "c", "1", 1, False), (6, "c", None, 2, True), (7, "d", "1", 0, True), (8, "d", "2", 1, False)])
    assert {r["k"]: r["v"] for r in resolve.live(df).collect()} == {"a": "2", "b": "1", "d": "2"}
    assert [r["k"] for r in resolve.deleted(df).collect()] == ["c"]


def test_reads(spark):
    df = log(spark, [(1, "a", "1", 0, False), (2, "ab", "2", 1, False), (3, "b", "3", 2, False), (4, "a", None, 3, True)])
    probes = spark.createDataFrame([("a",), ("b",), ("zz",), ("b",)], "k string")
    assert {r["k"]: (r["v"], r["found"]) for r in resolve.multi_get(df, probes).collect()} == {"a": (None, False), "b": ("3", True), "zz": (None, False)}
    assert {r["k"] for r in resolve.range_scan(df, F.lit("a"), F.lit("ab")).collect()} == {"ab"}
    assert {r["k"] for r in resolve.prefix_scan(df, "a").collect()} == {"ab"}
    assert {r["k"] for r in resolve.as_of(df, F.lit(T0 + dt.timedelta(days=1))).collect()} == {"a", "ab"}


def test_prefix_sum_across_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("x"))
    got = {r["seq"]: r["at"] for r in changelog.prefix_sum(df, F.col("x"), "at", width=64, base=5).collect()}
    total = 5
    for i in range(1000):
        assert got[i] == total
        total += i % 7


def test_record_sizes_and_chunk(spark):
    df = changelog.with_offsets(log(spark, [(0, "key1", "val1", 0, False), (1, "key2", "val2", 0, True), (2, "key3", "v", 0, False)]))
    assert [r["voff"] for r in df.orderBy("seq").collect()] == [0, 25, 50]
    assert [r["seq"] for r in changelog.chunk(df, 0, 26).orderBy("seq").collect()] == [0, 1]
    assert [r["seq"] for r in changelog.replay(df, 25).collect()] == [2]


@pytest.mark.parametrize("ttl, expected", [(False, {"new", "old", "fresh_gone"}), (True, {"new", "fresh_gone"})])
def test_compaction_rules(spark, ttl, expected):
    df = log(spark, [(1, "new", "1", 390, False), (2, "old", "1", 0, False), (3, "fresh_gone", None, 390, True), (4, "long_gone", "1", 1, False), (5, "long_gone", None, 2, True)])
    out = compaction.merge(df, F.lit(T0 + dt.timedelta(days=400)), S.Config(enable_ttl=ttl))
    assert {r["k"] for r in out.collect()} == expected
    kept = compaction.merge(df, F.lit(T0 + dt.timedelta(days=400)), S.Config(enable_ttl=ttl), drop_tombstones=False)
    assert "long_gone" in {r["k"] for r in kept.collect()}


def test_merge_is_independent_of_the_split_into_runs(spark):
    rows = [(i, f"k{i * 7 % 13}", str(i), i % 5, i % 6 == 0) for i in range(80)]
    whole = {tuple(r) for r in resolve.live(log(spark, rows)).collect()}
    one = compaction.merge(log(spark, rows[:30]), F.lit(T0), drop_tombstones=False)
    two = compaction.merge(log(spark, rows[30:]), F.lit(T0), drop_tombstones=False)
    assert {tuple(r) for r in resolve.live(one.unionByName(two)).collect()} == whole


def test_empty_runs(spark):
    empty = log(spark, [])
    assert compaction.merge(empty, F.lit(T0)).count() == 0
    assert runs.summarise(empty.withColumn("run_id", F.lit(1))).count() == 0


def test_reclaim(spark):
    df = changelog.with_offsets(log(spark, [(0, "a", "1", 0, False), (1, "b", "1", 0, False), (2, "a", "2", 1, False), (3, "b", None, 1, True)]))
    valid = {r["seq"]: r["valid"] for r in reclaim.classify(df, df).collect()}
    assert valid == {0: False, 1: False, 2: True, 3: False}
    assert [r["seq"] for r in reclaim.keep(df, resolve.live(df)).collect()] == [2]


def test_run_ranges_and_index(spark):
    runs_ = spark.createDataFrame([(1, "a", "c"), (2, "b", "f"), (3, "x", "z")], "run_id int, min_k string, max_k string")
    assert {r["run_id"] for r in runs.prune(runs_, F.lit("c")).collect()} == {1, 2}
    assert {r["run_id"] for r in runs.overlap(runs_, F.lit("d"), F.lit("y")).collect()} == {2, 3}
    index = spark.createDataFrame([(0, "f"), (1, "p")], "block_id long, last_key string")
    probes = spark.createDataFrame([("a",), ("g",), ("z",)], "k string")
    assert {r["k"]: r["block_id"] for r in runs.index_lookup(probes, index).collect()} == {"a": 0, "g": 1, "z": None}


def test_tiers():
    cfg = S.Config()
    assert tiering.fits_value(10_000, 10_000, cfg) and not tiering.fits_value(15_000, 10_000, cfg) and not tiering.fits_value(5_000, 10_000, cfg)
    assert tiering.fits_value(10, 4000, cfg) and not tiering.fits_value(4096, 1000, cfg)
    assert tiering.choose_tier({"x": [100_000], "y": [10_000, 12_000]}, 11_000, cfg) == "y"
    assert tiering.choose_tier({}, 1, cfg) is None


def test_bloom_rate(spark):
    n, p = 5_000, 0.01
    m, k = bloom.size(n, p)
    keys = spark.range(n).select(F.col("id").cast("string").alias("k"))
    others = spark.range(n, 3 * n).select(F.col("id").cast("string").alias("k"))
    words = bloom.build(keys, m, k)
    assert bloom.might_contain(keys, words, m, k).where(~F.col("maybe")).count() == 0
    assert bloom.might_contain(others, words, m, k).where("maybe").count() <= 1.6 * p * 2 * n


def test_bloom_sizing(spark):
    row = spark.range(1).select(bloom.bits(F.lit(1000), F.lit(0.01)).alias("m")).first()
    assert row["m"] == math.floor(1000 * -math.log(0.01) / math.log(2) ** 2)


@pytest.mark.parametrize("bad", [{"false_positive_rate": 0}, {"write_buffer_bytes": 1}, {"max_buffer_write_number": 0}, {"enable_ttl": True, "entry_ttl_ms": 1}, {"tombstone_ttl_ms": 1}, {"gc_chunk_bytes": 1}, {"prefetch_size": 0}])
def test_config_refuses(bad):
    with pytest.raises(ValueError):
        S.Config(**bad)


@pytest.mark.parametrize("name, ok", [("a", True), ("A-b_9", True), ("x" * 255, True), ("x" * 256, False), ("", False), ("a b", False), ("é", False), ("a/b", False)])
def test_keyspace_names(spark, name, ok):
    if ok:
        assert S.check_keyspace(name) == name
    else:
        with pytest.raises(ValueError):
            S.check_keyspace(name)
    assert spark.createDataFrame([(name,)], "n string").select(S.keyspace_valid(F.col("n"))).first()[0] is ok


def test_units():
    assert S.in_bytes(2, "KB") == 2048 and S.in_bytes(1, "gb") == 1024**3
