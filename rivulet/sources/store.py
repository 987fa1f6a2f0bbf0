"""A changelog table: a log of batches, sorted runs and a versioned manifest."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import schema as S
from rivulet.operators import bloom, changelog, compaction, resolve, runs, tiering
from rivulet.sources.manifest import ManifestDir


#: Bytes of records in one file of a run.
FILE_BYTES = 128 << 20


class Background(threading.Thread):
    """Runs a job again and again until stopped. A conflict with another writer waits for the next turn; other errors end it."""

    def __init__(self, job: Callable[[], None], every: float):
        super().__init__(daemon=True)
        self.job, self.every, self.error = job, every, None
        self._ended = threading.Event()
        self.start()

    def run(self) -> None:
        while not self._ended.wait(self.every):
            try:
                self.job()
            except S.ConflictError:
                continue
            except Exception as e:  # kept for stop()
                self.error = e
                return

    def stop(self) -> None:
        """Waits for a job that runs; raises what ended the thread."""
        self._ended.set()
        self.join()
        if self.error is not None:
            raise self.error


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _source(epoch: str) -> tuple[str, int]:
    """Checkpoint and number of an epoch ``checkpoint#number``; any other name stands for itself."""
    name, _, number = epoch.rpartition("#")
    return (name, int(number)) if name and number.isascii() and number.isdigit() else (epoch, 0)


class Store:
    """One keyspace under a root folder. One writer at a time; readers keep the version they opened.

    Every change writes new files first and then commits a manifest version that names them, so a crash in
    between leaves orphans that nothing reads. Merging and reclaiming only stop naming files: :meth:`vacuum` removes
    what no retained version names, so a reader is safe for as long as versions are retained.
    """

    def __init__(self, spark: SparkSession, name: str, root: str, cfg: S.Config, version: int | None = None):
        self.spark, self.name, self.cfg = spark, S.check_keyspace(name), cfg
        self.path = f"{root.rstrip('/')}/{name}"
        self._manifests = ManifestDir(spark, f"{self.path}/_manifest")
        self.state = self._manifests.read(version) or self._fresh()

    def __repr__(self) -> str:
        return f"Store({self.name!r}, version={self.state['version']}, runs={len(self.state['runs'])})"

    @classmethod
    def open(cls, spark: SparkSession, name: str, root: str, cfg: S.Config | None = None, version: int | None = None) -> Store:
        """Opens a keyspace, recovering what its newest (or a given) manifest names, or starts an empty one."""
        return cls(spark, name, root, cfg or S.Config(), version)

    def with_config(self, **changes) -> Store:
        out = Store(self.spark, self.name, self.path.rsplit("/", 1)[0], replace(self.cfg, **changes))
        return out

    @staticmethod
    def _fresh() -> dict:
        return {"version": 0, "next_seq": 0, "log_bytes": 0, "head": -1, "tail": 0, "batches": [], "runs": [], "epochs": {}}

    def _commit(self, **changes) -> None:
        body = self.state | changes | {"last_modified": _now().isoformat()}
        version = self.state["version"] + 1
        self._manifests.commit(body, version)
        self.state = body | {"version": version}

    def _epochs(self) -> dict[str, int]:
        """The highest committed epoch by checkpoint; older manifests hold a list of epochs."""
        held = self.state["epochs"]
        if isinstance(held, dict):
            return dict(held)
        out: dict[str, int] = {}
        for source, number in map(_source, held):
            out[source] = max(number, out.get(source, -1))
        return out

    def refresh(self) -> Store:
        self.state = self._manifests.read() or self._fresh()
        return self

    # --- writing --------------------------------------------------------------------------------

    def append(self, log: DataFrame, epoch: str | None = None) -> int:
        """Appends records (k, v, is_tombstone and, if known, seq and created_at) as one batch; returns how many.

        Null times become the time of the commit. Without seq, records get rising numbers after all earlier ones.
        A batch with any bad size is refused whole. An ``epoch`` already committed is not appended again: of each
        checkpoint the highest number is kept, as a stream commits its epochs in rising order.
        """
        epochs = self._epochs()
        if epoch is not None:
            source, number = _source(epoch)
            if epochs.get(source, -1) >= number:
                return 0
            epochs[source] = number
        if "is_tombstone" not in log.columns:
            log = log.withColumn("is_tombstone", F.lit(False))
        if "seq" not in log.columns:
            log = log.withColumn("seq", F.monotonically_increasing_id() + self.state["next_seq"])
        now = F.lit(_now()).cast("timestamp")
        log = log.withColumn("created_at", F.coalesce(F.col("created_at").cast("timestamp"), now) if "created_at" in log.columns else now)
        log = log.select("seq", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"), "created_at", F.coalesce("is_tombstone", F.lit(False)).alias("is_tombstone"))
        path = f"{self.path}/log/batch-{uuid.uuid4().hex}"
        log.withColumn("verdict", S.size_class(F.col("k"), F.col("v"), F.col("is_tombstone"))).write.parquet(path)
        seen = self.spark.read.parquet(path).groupBy("verdict").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum(changelog.record_size()).alias("b")).collect()
        wrong = sorted(r["verdict"] for r in seen if r["verdict"] != "ok")
        if wrong:
            self._manifests.delete_tree(path)
            raise {"KeySizeNone": S.KeySizeNone, "KeyMaxSizeExceeded": S.KeyMaxSizeExceeded, "ValueSizeNone": S.ValueSizeNone, "ValueMaxSizeExceeded": S.ValueMaxSizeExceeded}[wrong[0]](f"batch refused: {', '.join(wrong)}")
        if not seen:
            self._manifests.delete_tree(path)
            return 0
        r = seen[0]
        batch = {"path": path, "n": r["n"], "min_seq": r["lo"], "max_seq": r["hi"], "bytes": r["b"], "offset": self.state["log_bytes"]}
        self._commit(
            batches=[*self.state["batches"], batch], next_seq=max(self.state["next_seq"], r["hi"] + 1), log_bytes=self.state["log_bytes"] + r["b"],
            epochs=epochs,
        )
        return r["n"]

    def put_many(self, pairs: DataFrame) -> int:
        return self.append(pairs.withColumn("is_tombstone", F.lit(False)))

    def delete_many(self, keys: DataFrame, strict: bool = False) -> int:
        """Deletes keys; strict: refuses if any is not live."""
        if strict:
            self._require(keys)
        return self.append(keys.select("k", F.lit(None).cast("binary").alias("v"), F.lit(True).alias("is_tombstone")))

    def update_many(self, pairs: DataFrame, strict: bool = False) -> int:
        """Puts; strict: refuses if any key is not live."""
        if strict:
            self._require(pairs)
        return self.put_many(pairs)

    def _require(self, keys: DataFrame) -> None:
        wanted = keys.select(F.col("k").cast("binary").alias("k")).distinct()
        absent = wanted.join(self.live().select("k"), "k", "left_anti").take(1)
        if absent:
            raise S.KeyNotFound(bytes(absent[0]["k"]).decode(errors="replace"))

    def _pair(self, k, v=None) -> DataFrame:
        as_bytes = lambda x: None if x is None else bytearray(x.encode() if isinstance(x, str) else x)
        return self.spark.createDataFrame([(as_bytes(k), as_bytes(v))], "k binary, v binary")

    def put(self, k, v) -> bool:
        return self.put_many(self._pair(k, v)) == 1

    def update(self, k, v, strict: bool = False) -> bool:
        return self.update_many(self._pair(k, v), strict) == 1

    def delete(self, k, strict: bool = False) -> bool:
        return self.delete_many(self._pair(k), strict) == 1

    # --- reading --------------------------------------------------------------------------------

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], S.LOG)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(S.LOG).parquet(*paths) if paths else self._empty()

    def pending(self) -> list[dict]:
        """Batches not yet in a run."""
        return [b for b in self.state["batches"] if b["offset"] > self.state["head"]]

    def _range(self, low: bytes | None, high: bytes | None) -> list[dict]:
        inside = lambda r: (high is None or bytes.fromhex(r["min_k"]) <= high) and (low is None or bytes.fromhex(r["max_k"]) >= low)
        return [r for r in self.state["runs"] if inside(r)]

    def records(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions that runs and pending batches hold, of runs whose key range meets the interval."""
        df = self._read([r["path"] for r in self._range(low, high)] + [b["path"] for b in self.pending()])
        if low is not None and low == high:
            return df.where(F.col("k") == F.lit(bytearray(low)))  # an equality, which asks the runs' Bloom filters too
        if low is not None:
            df = df.where(F.col("k") >= F.lit(bytearray(low)))
        if high is not None:
            df = df.where(F.col("k") <= F.lit(bytearray(high)))
        return df

    def live(self) -> DataFrame:
        return resolve.live(self.records())

    def get(self, k) -> bytes | None:
        """The newest value of a key; None if it is absent or deleted."""
        key = k.encode() if isinstance(k, str) else bytes(k)
        if not key:
            raise S.KeySizeNone("a key is empty")
        rows = resolve.live(self.records(key, key)).select("v").take(1)
        return bytes(rows[0]["v"]) if rows else None

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return resolve.multi_get(self.records(), probes.select(F.col("k").cast("binary").alias("k")))

    def range_scan(self, low: bytes, high: bytes) -> DataFrame:
        """Live records with low <= key <= high, in key order."""
        return resolve.live(self.records(low, high)).orderBy("k")

    def prefix_scan(self, prefix: bytes) -> DataFrame:
        body = prefix.rstrip(b"\xff")
        high = body[:-1] + bytes([body[-1] + 1]) if body else None
        df = self.records(prefix, high)
        return resolve.live(df.where(F.substring("k", 1, len(prefix)) == F.lit(bytearray(prefix)))).orderBy("k")

    def as_of(self, at: dt.datetime) -> DataFrame:
        """Live records at a past time; complete back to the last compaction, which drops older versions."""
        return resolve.as_of(self.records(), F.lit(at).cast("timestamp"))

    def log(self) -> DataFrame:
        """Log records still stored, with their offsets."""
        batches = self.state["batches"]
        rows = self._read([b["path"] for b in batches])
        if not batches:
            return changelog.with_offsets(rows)
        name = lambda path: path.rsplit("/", 1)[1]
        begins = self.spark.createDataFrame([(name(b["path"]), b["offset"]) for b in batches], "_batch string, _begin long")  # a row for each batch that the manifest names
        rows = rows.withColumn("_batch", F.regexp_extract("_metadata.file_path", "/(batch-[0-9a-f]+)/", 1))
        placed = changelog.with_offsets(rows, by="_batch").join(F.broadcast(begins), "_batch")
        return placed.withColumn("voff", F.col("voff") + F.col("_begin")).drop("_batch", "_begin")

    def n_buffered_keys(self) -> int:
        return self._read([b["path"] for b in self.pending()]).select("k").distinct().count()

    # --- runs -----------------------------------------------------------------------------------

    def _write_run(self, entries: DataFrame, expected: int, size: int, tier: str | None, hotness: int) -> dict | None:
        """Writes entries in key order; ``expected`` and ``size``: at most so many, of so many bytes."""
        path = f"{self.path}/runs/run-{uuid.uuid4().hex}"
        ordered = entries.repartitionByRange(size // FILE_BYTES + 1, "k").sortWithinPartitions("k").select(*S.LOG.names)
        m, _ = bloom.size(max(1, expected), self.cfg.false_positive_rate)
        ordered.write.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", str(max(1, expected))).option("parquet.bloom.filter.max.bytes", str(min(max(m // 8, 1024), 64 << 20))).parquet(path)
        made = self._read([path]).withColumn("run_id", F.lit(1))
        r = runs.summarise(made).join(made.groupBy("run_id").agg(F.sum(changelog.record_size()).alias("bytes")), "run_id").first()
        if r is None:
            self._manifests.delete_tree(path)
            return None
        return {
            "path": path, "tier": tier, "min_k": bytes(r["min_k"]).hex(), "max_k": bytes(r["max_k"]).hex(), "n": r["n_entries"], "n_tombstones": r["n_tombstones"],
            "size": r["size_bytes"], "bytes": r["bytes"], "hotness": hotness, "created_at": _now().isoformat(),
        }

    def _place(self, run: dict, among: list[dict]) -> list[dict]:
        """Puts a run in the first tier that takes it; its members' hotness goes up by one."""
        tiers: dict[str, list[int]] = {}
        for r in among:
            tiers.setdefault(r["tier"], []).append(r["size"])
        run["tier"] = tiering.choose_tier(tiers, run["size"], self.cfg) or uuid.uuid4().hex
        return [r | {"hotness": r["hotness"] + 1} if r["tier"] == run["tier"] else r for r in among] + [run]

    def flush(self) -> bool:
        """Writes all pending batches as one sorted run. The head moves only with the commit that names the run."""
        pending = self.pending()
        if not pending:
            return False
        run = self._write_run(resolve.latest(self._read([b["path"] for b in pending])), sum(b["n"] for b in pending), sum(b["bytes"] for b in pending), None, 0)
        self._commit(runs=self._place(run, self.state["runs"]) if run else self.state["runs"], head=max(b["offset"] for b in pending))
        return run is not None

    def full(self) -> bool:
        """Whether enough is buffered for a flush."""
        pending = self.pending()
        return len(pending) >= self.cfg.max_buffer_write_number or sum(b["bytes"] for b in pending) >= self.cfg.write_buffer_bytes

    def compact(self, as_of: dt.datetime | None = None) -> int:
        """Merges tiers until none has too many runs; returns how many merges ran. Without ``as_of``, nothing expires."""
        at = F.lit(as_of).cast("timestamp") if as_of is not None else F.lit(dt.datetime(1970, 1, 1)).cast("timestamp")
        merges = 0
        while True:
            tiers: dict[str, list[dict]] = {}
            for r in self.state["runs"]:
                tiers.setdefault(r["tier"], []).append(r)
            chosen = next((t for t in tiers.values() if len(t) >= self.cfg.min_threshold), None)
            if chosen is None:
                return merges
            chosen = chosen[: self.cfg.max_threshold]
            paths = {r["path"] for r in chosen}
            rest = [r for r in self.state["runs"] if r["path"] not in paths]
            low, high = min(bytes.fromhex(r["min_k"]) for r in chosen), max(bytes.fromhex(r["max_k"]) for r in chosen)
            alone = not any(bytes.fromhex(r["min_k"]) <= high and bytes.fromhex(r["max_k"]) >= low for r in rest)
            merged = compaction.merge(self._read(sorted(paths)), at, self.cfg, drop_tombstones=alone)
            run = self._write_run(merged, sum(r["n"] for r in chosen), sum(r.get("bytes", r["size"]) for r in chosen), None, sum(r["hotness"] for r in chosen))
            self._commit(runs=self._place(run, rest) if run else rest)
            merges += 1

    def reclaim(self) -> dict:
        """Stops naming log batches that runs already hold; runs keep values, times and order, so nothing is rewritten."""
        done = [b for b in self.state["batches"] if b["offset"] <= self.state["head"]]
        rest = [b for b in self.state["batches"] if b["offset"] > self.state["head"]]
        if done:
            self._commit(batches=rest, tail=max(b["offset"] + b["bytes"] for b in done))
        return {"batches": len(done), "bytes": sum(b["bytes"] for b in done)}

    def collect_garbage(self) -> dict:
        """Goes through the oldest batches, about ``gc_chunk_bytes`` of them, and writes again what is still needed.

        Needed is a record that no run holds yet and that is its key's newest, deletes included: older values may stand
        in runs. It keeps its time and number, so the order of records stays.
        """
        chosen: list[dict] = []
        for b in self.state["batches"]:
            if sum(c["bytes"] for c in chosen) >= self.cfg.gc_chunk_bytes:
                break
            chosen.append(b)
        if not chosen:
            return {"batches": 0, "bytes": 0, "kept": 0}
        rest = self.state["batches"][len(chosen) :]
        held = self._read([b["path"] for b in chosen if b["offset"] > self.state["head"]])
        newest = resolve.latest(self.records().join(held.select("k").distinct(), "k", "left_semi")).select("k", "created_at", "seq")
        path = f"{self.path}/log/batch-{uuid.uuid4().hex}"
        held.join(newest, ["k", "created_at", "seq"], "left_semi").select(*S.LOG.names).write.parquet(path)
        r = self._read([path]).agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum(changelog.record_size()).alias("b")).first()
        kept = []
        if r["n"]:
            kept = [{"path": path, "n": r["n"], "min_seq": r["lo"], "max_seq": r["hi"], "bytes": r["b"], "offset": self.state["log_bytes"]}]
        else:
            self._manifests.delete_tree(path)
        end = max(b["offset"] + b["bytes"] for b in chosen)
        self._commit(batches=[*rest, *kept], log_bytes=self.state["log_bytes"] + (r["b"] or 0), tail=end)
        return {"batches": len(chosen), "bytes": sum(b["bytes"] for b in chosen) - (r["b"] or 0), "kept": r["n"]}

    def vacuum(self, retain: dt.timedelta = dt.timedelta(days=7)) -> list[str]:
        """Removes versions older than ``retain``, the newest excepted, and files that no version left names; returns the files' folders.

        Files written within that time stay too: a commit that names them may follow.
        """
        limit = _now() - retain
        versions = self._manifests.versions()
        bodies = {v: self._manifests.read(v) for v in versions}
        old = [v for v in versions[:-1] if dt.datetime.fromisoformat(bodies[v]["last_modified"]) < limit]
        named = {x["path"].rsplit("/", 1)[1] for v, body in bodies.items() if v not in old for x in [*body["runs"], *body["batches"]]}
        gone = []
        for folder in ("log", "runs"):
            for path, changed in self._manifests.folders(f"{self.path}/{folder}"):
                if path.rsplit("/", 1)[1] not in named and changed < limit:
                    gone.append(path)
        for v in old:
            self._manifests.remove(v)
        for path in gone:
            self._manifests.delete_tree(path)
        return gone

    def maintain(self, as_of: dt.datetime | None = None, retain: dt.timedelta = dt.timedelta(days=7)) -> None:
        """What a scheduler calls: flush if full, compact, reclaim, vacuum."""
        if self.full():
            self.flush()
        self.compact(as_of)
        self.reclaim()
        self.vacuum(retain)

    def start_background_tasks(self, every: float = 300.0, expire: bool = False) -> Background:
        """Maintains a handle of its own on this keyspace every so many seconds, in a thread, until stopped."""
        own = self.with_config()
        return Background(lambda: own.refresh().maintain(_now() if expire else None), every)

    def manifest(self) -> DataFrame:
        """The runs as a table."""
        rows = [(r["path"].rsplit("/", 1)[1], r["tier"], r["path"], bytearray.fromhex(r["min_k"]), bytearray.fromhex(r["max_k"]), r["n"], r["n_tombstones"], r["size"], r["hotness"]) for r in self.state["runs"]]
        return self.spark.createDataFrame(rows, "run_id string, tier_id string, path string, min_k binary, max_k binary, n_entries long, n_tombstones long, size_bytes long, hotness long")
