import datetime as dt

import pytest
from pyspark.sql import functions as F

from rivulet.functions import schema as S
from rivulet.sources.store import Store


def pairs(spark, d):
    return spark.createDataFrame([(k, v) for k, v in d.items()], "k string, v string")


def content(store):
    return {bytes(r["k"]).decode(): bytes(r["v"]).decode() for r in store.live().collect()}


def test_life_of_a_key(spark, tmp_path):
    s = Store.open(spark, "one", str(tmp_path))
    assert s.get("apple") is None
    s.put("apple", "tim")
    assert s.get("apple") == b"tim"
    s.update("apple", "craig")
    s.flush()
    assert s.get("apple") == b"craig" and not s.pending()
    s.delete("apple")
    assert s.get("apple") is None
    s.flush()
    assert s.get("apple") is None
    s.put("apple", "back")
    assert s.get(b"apple") == b"back"
    s.delete("never-there")
    with pytest.raises(S.KeyNotFound):
        s.delete("never-there", strict=True)


def test_recovery_compaction_and_reclaim_keep_the_view(spark, tmp_path):
    s = Store.open(spark, "many", str(tmp_path))
    want = {}
    for i in range(6):
        batch = {f"k{j:03d}": f"{i}-{j}" for j in range(i * 5, i * 5 + 20)}
        s.put_many(pairs(spark, batch))
        want |= batch
        gone = f"k{i * 5 + 1:03d}"
        s.delete_many(pairs(spark, {gone: ""}).select("k"))
        want.pop(gone, None)
        s.flush()
    assert content(s) == want
    runs = s.manifest().count()
    assert s.compact() > 0 and s.manifest().count() < runs
    assert content(s) == want
    assert s.reclaim()["batches"] == 12
    again = Store.open(spark, "many", str(tmp_path))
    assert content(again) == want and again.state["version"] == s.state["version"]
    assert [bytes(r["k"]).decode() for r in again.range_scan(b"k002", b"k010").collect()] == sorted(k for k in want if "k002" <= k <= "k010")
    assert {bytes(r["k"]).decode() for r in again.prefix_scan(b"k00").collect()} == {k for k in want if k.startswith("k00")}
    probes = pairs(spark, {"k003": "", "nope": ""}).select("k")
    assert {bytes(r["k"]).decode(): r["found"] for r in again.multi_get(probes).collect()} == {"k003": True, "nope": False}


def test_expired_tombstones_go_and_old_values_stay_gone(spark, tmp_path):
    s = Store.open(spark, "ttl", str(tmp_path))
    old = dt.datetime(2020, 1, 1)
    rows = [("a", "1", old, False), ("b", "1", old, False)]
    schema = "k string, v string, created_at timestamp, is_tombstone boolean"
    s.append(spark.createDataFrame(rows, schema))
    s.flush()
    s.append(spark.createDataFrame([("a", None, old + dt.timedelta(days=1), True)], schema))
    s.flush()
    for i in range(3):
        s.append(spark.createDataFrame([(f"c{i}", "1", old, False)], schema))
        s.flush()
    assert s.compact(as_of=old + dt.timedelta(days=300)) >= 1
    assert set(content(s)) == {"b", "c0", "c1", "c2"}
    assert s.records().where(F.col("is_tombstone")).count() == 0


def test_refused_batches_leave_nothing(spark, tmp_path):
    s = Store.open(spark, "sizes", str(tmp_path))
    for k, v, error in [("", "v", S.KeySizeNone), (None, "v", S.KeySizeNone), ("k", "", S.ValueSizeNone), ("k" * 65537, "v", S.KeyMaxSizeExceeded)]:
        with pytest.raises(error):
            s.put_many(spark.createDataFrame([("good", "v"), (k, v)], "k string, v string"))
    assert s.state["batches"] == [] and s.get("good") is None


def test_old_versions_stay_readable_and_two_writers_conflict(spark, tmp_path):
    s = Store.open(spark, "v", str(tmp_path))
    s.put("a", "1")
    t = Store.open(spark, "v", str(tmp_path))
    s.put("a", "2")
    assert Store.open(spark, "v", str(tmp_path), version=1).get("a") == b"1"
    with pytest.raises(S.ConflictError):
        t.put("a", "3")
    assert t.refresh().get("a") == b"2"


def test_binary_keys_and_as_of(spark, tmp_path):
    s = Store.open(spark, "bin", str(tmp_path))
    s.put(b"\xff\x00", b"\x80*")
    assert s.get(b"\xff\x00") == b"\x80*"
    at = dt.datetime(2021, 5, 1)
    s.append(spark.createDataFrame([("x", "1", at), ("x", "2", at + dt.timedelta(days=2))], "k string, v string, created_at timestamp"))
    assert [bytes(r["v"]) for r in s.as_of(at + dt.timedelta(days=1)).collect()] == [b"1"]
    assert s.n_buffered_keys() == 2
    s.with_config(min_threshold=3).maintain()


def test_readers_survive_compaction_and_reclaiming_until_vacuum(spark, tmp_path):
    s = Store.open(spark, "readers", str(tmp_path), S.Config(min_threshold=2))
    for i in range(2):
        s.put_many(spark.createDataFrame([(f"a{i}", "1"), ("b", str(i))], "k string, v string"))
        s.flush()
    reader = Store.open(spark, "readers", str(tmp_path))
    lazy, log = reader.live(), reader.log()
    assert s.compact() == 1 and s.reclaim()["batches"] == 2
    assert content(reader) == content(s) and lazy.count() == 3 and log.count() == 4 and reader.get("b") == b"1"
    assert s.vacuum() == [] and reader.live().count() == 3
    assert len(s.vacuum(dt.timedelta(0))) == 4  # two merged runs, two reclaimed batches
    assert content(s) == {"a0": "1", "a1": "1", "b": "1"} and Store.open(spark, "readers", str(tmp_path)).state["version"] == s.state["version"]


def test_log_offsets_run_through_all_batches(spark, tmp_path):
    s = Store.open(spark, "offsets", str(tmp_path))
    for i in range(3):
        s.put_many(spark.createDataFrame([(f"k{i}{j}", "v" * (j + 1)) for j in range(5)], "k string, v string"))
    rows = sorted((r["voff"], r["rec_size"]) for r in s.log().collect())
    assert rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and rows[-1][0] + rows[-1][1] == s.state["log_bytes"]


def test_garbage_collection_keeps_the_newest(spark, tmp_path):
    s = Store.open(spark, "gc", str(tmp_path))
    s.put_many(spark.createDataFrame([("a", "old"), ("b", "1"), ("c", "1")], "k string, v string"))
    s.flush()
    s.put_many(spark.createDataFrame([("a", "new"), ("d", "1")], "k string, v string"))
    s.delete("c")
    s.put("d", "2")
    before = content(s)
    done = s.collect_garbage()
    assert done["batches"] == 4 and done["kept"] == 3 and content(s) == before == {"a": "new", "b": "1", "d": "2"}
    s.flush()
    assert content(s) == before


def test_background_maintenance(spark, tmp_path):
    s = Store.open(spark, "bg", str(tmp_path))
    for i in range(2):
        s.put(f"k{i}", "1")
    tasks = s.start_background_tasks(every=0.1)
    end = dt.datetime.now() + dt.timedelta(seconds=60)
    while not s.refresh().state["runs"] and dt.datetime.now() < end:
        pass
    tasks.stop()
    assert s.refresh().state["runs"] and s.pending() == [] and content(s) == {"k0": "1", "k1": "1"}
