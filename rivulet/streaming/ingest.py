"""Streams into a store, and a materialised latest view with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.sources.store import Store


def stream_into(log: DataFrame, store: Store, checkpoint: str, flush_every: int = 8, available_now: bool = True):
    """Appends a stream of log records batch by batch. A batch delivered twice is appended once: its epoch is in the manifest."""

    def write(batch: DataFrame, epoch: int) -> None:
        store.append(batch, f"{checkpoint}#{epoch}")
        if len(store.pending()) >= flush_every:
            store.flush()

    query = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=available_now or None).start()
    if available_now:
        query.awaitTermination()
    return query


def stream_of_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet table, be it one file or a folder of files."""
    table = spark.read.parquet(path)
    folder = path if not table.inputFiles() or table.inputFiles()[0].rsplit("/", 1)[0].endswith(path.rsplit("/", 1)[1]) else path.rsplit("/", 1)[0]
    names = "*.parquet" if folder == path else path.rsplit("/", 1)[1]
    return spark.readStream.schema(table.schema).option("pathGlobFilter", names).parquet(folder)


def deduplicated(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Records delivered again within ``delay`` dropped, by key and sequence number."""
    return log.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["k", "seq"])


#: The provider that stateful views need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_view(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of changes of the latest view: one row per key and micro-batch in which its newest record changed.

    State per key is its newest record, kept ``ttl_ms`` milliseconds of processing time if given.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql import types as T

    state = T.StructType([T.StructField("created_at", T.TimestampType()), T.StructField("seq", T.LongType())])

    class Newest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.best = handle.getValueState("best", state, ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            frame = pd.concat(list(rows)).sort_values(["created_at", "seq"]).tail(1)
            top = frame.iloc[0]
            now = (top["created_at"].to_pydatetime(), int(top["seq"]))
            if not self.best.exists() or tuple(self.best.get()) < now:
                self.best.update(now)
                yield frame

        def close(self) -> None:
            pass

    return log.groupBy("k").transformWithStateInPandas(statefulProcessor=Newest(), outputStructType=log.schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def windowed_counts(log: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Puts and deletes per time window, late records up to ``delay`` counted."""
    return log.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "is_tombstone").agg(F.count("*").alias("n"))
