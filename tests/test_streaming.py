import datetime as dt

from pyspark.sql import functions as F

from rivulet.sources.store import Store
from rivulet.streaming import ingest

SCHEMA = "seq long, k string, v string, created_at timestamp, is_tombstone boolean"
T0 = dt.datetime(2024, 1, 1)


def write(spark, folder, rows):
    spark.createDataFrame([(s, k, v, T0 + dt.timedelta(hours=h), g) for s, k, v, h, g in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_counts_a_delivery_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(1, "a", "1", 0, False), (2, "b", "1", 0, False)])
    store = Store.open(spark, "s", str(tmp_path))
    source = lambda: spark.readStream.schema(SCHEMA).parquet(folder)
    ingest.stream_into(source(), store, str(tmp_path / "cp"))
    write(spark, folder, [(3, "a", "2", 1, False), (4, "b", None, 1, True)])
    ingest.stream_into(source(), store, str(tmp_path / "cp"))
    assert {bytes(r["k"]): bytes(r["v"]) for r in store.live().collect()} == {b"a": b"2"}
    n = store.records().count()
    assert store.append(spark.read.parquet(folder), f"{tmp_path / 'cp'}#1") == 0 and store.records().count() == n


def test_a_late_redelivery_after_many_epochs_of_other_streams(spark, tmp_path):
    store = Store.open(spark, "s", str(tmp_path))
    one = spark.createDataFrame([("a", "1")], "k string, v string").coalesce(1)
    store.state["epochs"] = ["slow#7", *(f"fast#{i}" for i in range(99))]  # as older manifests hold them
    assert store.append(one, "fast#99") == 1
    store = Store.open(spark, "s", str(tmp_path))
    assert store.append(one, "slow#7") == 0 and store.append(one, "fast#99") == 0
    assert store.append(one, "slow#8") == 1 and store.records().count() == 2


def test_latest_view_with_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(1, "a", "1", 0, False), (2, "a", "2", 1, False), (3, "b", "1", 0, False)])
    ingest.use_rocksdb(spark)
    view = ingest.latest_view(spark.readStream.schema(SCHEMA).parquet(folder))
    out = []
    q = view.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["v"]) for r in out} == {("a", "2"), ("b", "1")}


def test_windowed_counts_and_duplicates(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [(1, "a", "1", 0, False), (1, "a", "1", 0, False), (2, "a", "2", 5, True)])
    source = spark.readStream.schema(SCHEMA).parquet(folder)
    for name, df in (("unique_rows", ingest.deduplicated(source)), ("counts", ingest.windowed_counts(source))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "unique_rows" else "complete").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("unique_rows").count() == 2
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]
    assert spark.table("counts").where(F.col("is_tombstone")).count() == 1
