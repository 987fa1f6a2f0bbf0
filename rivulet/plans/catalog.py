"""The queries of the changelog engine over the test tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.schema import DAY_MS, Config, keyspace_valid, size_class
from rivulet.operators import bloom, changelog, compaction, reclaim, resolve, runs, tiering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CAPACITY = 51200
TIES = ("created_at", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return put


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a changelog."""
    gone = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k"),
        F.when(gone, "*").otherwise(F.col("props")).alias("v"),
        F.col("ts").alias("created_at"),
        gone.alias("is_tombstone"),
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return changelog.with_offsets(events(spark, sf))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """The line items as a changelog: many keys, equal times."""
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("k"),
        F.col("l_quantity").alias("v"),
        F.col("l_shipdate").alias("created_at"),
        (F.col("l_returnflag") == "R").alias("is_tombstone"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )


def _keys(spark: SparkSession, *keys: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("k"))


EV = """ev AS (SELECT event_id AS seq, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k,
 CASE WHEN event_type = 'error' THEN '*' ELSE props END AS v, ts AS created_at, event_type = 'error' AS is_tombstone FROM events)"""
LOG = EV + """, sized AS (SELECT *, CAST(17 + octet_length(encode(k)) + octet_length(encode(v)) AS BIGINT) AS rec_size FROM ev),
lg AS (SELECT *, CAST(coalesce(sum(rec_size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS voff FROM sized)"""
NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, seq DESC) AS rn FROM {src}) WHERE rn = 1)"""
LI = """li AS (SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS k, l_quantity AS v, l_shipdate AS created_at, l_returnflag = 'R' AS is_tombstone,
 l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM li) WHERE rn = 1)"""


@query(f"WITH {LOG} SELECT seq, k, rec_size, voff FROM lg")
def kv_vlog_offsets(spark, sf):
    return event_log(spark, sf).select("seq", "k", "rec_size", "voff")


@query(f"WITH {EV}, {NEWEST.format(src='ev')} SELECT k, v, created_at, seq FROM newest WHERE NOT is_tombstone")
def kv_get_latest(spark, sf):
    return resolve.live(events(spark, sf)).select("k", "v", "created_at", "seq")


@query(f"WITH {LI} SELECT k, v, created_at, l_orderkey FROM newest WHERE NOT is_tombstone")
def kv_get_latest_ties(spark, sf):
    return resolve.live(items(spark, sf), recency=TIES).select("k", "v", "created_at", "l_orderkey")


@query(f"""WITH {EV}, {NEWEST.format(src='ev')}, probe AS (SELECT unnest(['u000001', 'u000007', 'u000042', 'u000100', 'no-such-key']) AS k)
SELECT probe.k, n.v, n.k IS NOT NULL AS found FROM probe LEFT JOIN (SELECT * FROM newest WHERE NOT is_tombstone) n ON probe.k = n.k""")
def kv_multi_get(spark, sf):
    probes = _keys(spark, "u000001", "u000007", "u000042", "u000100", "no-such-key")
    return resolve.multi_get(events(spark, sf), probes).select("k", "v", "found")


@query(f"""WITH {LI}, probe AS (SELECT DISTINCT 'p' || lpad(CAST(p_partkey * 2 AS VARCHAR), 8, '0') AS k FROM part)
SELECT probe.k, n.v, n.k IS NOT NULL AS found FROM probe LEFT JOIN (SELECT * FROM newest WHERE NOT is_tombstone) n ON probe.k = n.k""")
def kv_multi_get_many(spark, sf):
    probes = spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("p"), F.lpad((F.col("p_partkey") * 2).cast("string"), 8, "0")).alias("k")).distinct()
    hits = resolve.live(items(spark, sf).join(probes, "k", "left_semi"), recency=TIES).select("k", "v", F.lit(True).alias("found"))
    return probes.join(hits, "k", "left").select("k", "v", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"WITH {EV}, {NEWEST.format(src='ev')} SELECT k, v, seq FROM newest WHERE NOT is_tombstone AND k BETWEEN 'u000010' AND 'u000060'")
def kv_range_scan(spark, sf):
    return resolve.range_scan(events(spark, sf), F.lit("u000010"), F.lit("u000060")).select("k", "v", "seq")


@query(f"WITH {EV}, {NEWEST.format(src='ev')} SELECT k, v, seq FROM newest WHERE NOT is_tombstone AND starts_with(k, 'u00001')")
def kv_prefix_scan(spark, sf):
    return resolve.prefix_scan(events(spark, sf), "u00001").select("k", "v", "seq")


@query(f"WITH {EV}, {NEWEST.format(src='ev')} SELECT k, created_at, seq FROM newest WHERE is_tombstone")
def kv_tombstones(spark, sf):
    return resolve.deleted(events(spark, sf)).select("k", "created_at", "seq")


@query(f"""WITH {LOG}, m AS (SELECT *, CAST(floor(voff / {CAPACITY}.0) AS BIGINT) AS memtable_id FROM lg)
SELECT memtable_id, min(k) AS min_k, max(k) AS max_k, count(*) AS n_entries, CAST(sum(CAST(is_tombstone AS INT)) AS BIGINT) AS n_tombstones,
CAST(sum(octet_length(encode(k)) + 17) AS BIGINT) AS size_bytes FROM m GROUP BY memtable_id""")
def kv_memtable_flush(spark, sf):
    return runs.summarise(runs.memtables(event_log(spark, sf), CAPACITY), "memtable_id")


@query(f"""WITH {LOG}, m AS (SELECT *, CAST(floor(voff / {CAPACITY}.0) AS BIGINT) AS memtable_id FROM lg)
SELECT memtable_id, CAST(sum(octet_length(encode(k)) + 13) AS BIGINT) AS size_bytes, count(DISTINCT k) AS n_keys, max(voff) AS most_recent_offset FROM m GROUP BY memtable_id""")
def kv_memtable_size(spark, sf):
    return runs.memtable_size(runs.memtables(event_log(spark, sf), CAPACITY))


@query(f"""WITH {LOG}, m AS (SELECT *, CAST(floor(voff / {CAPACITY}.0) AS BIGINT) AS memtable_id FROM lg),
n AS (SELECT *, row_number() OVER (PARTITION BY memtable_id, k ORDER BY created_at DESC, seq DESC) AS rn FROM m)
SELECT memtable_id, k, voff, is_tombstone FROM n WHERE rn = 1""")
def kv_memtable_entries(spark, sf):
    from pyspark.sql import Window

    log = runs.memtables(event_log(spark, sf), CAPACITY)
    w = Window.partitionBy("memtable_id", "k").orderBy(F.desc("created_at"), F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("memtable_id", "k", "voff", "is_tombstone")


RUNS = f"""{LI.split(', newest')[0].rsplit('newest', 1)[0].rstrip().rstrip(',')}, rs AS (SELECT l_suppkey AS run_id, min(k) AS min_k, max(k) AS max_k, count(*) AS n_entries,
CAST(sum(CAST(is_tombstone AS INT)) AS BIGINT) AS n_tombstones, CAST(sum(octet_length(encode(k)) + 17) AS BIGINT) AS size_bytes FROM li GROUP BY l_suppkey)"""


def item_runs(spark, sf):
    return runs.summarise(items(spark, sf), "l_suppkey").withColumnRenamed("l_suppkey", "run_id")


@query(f"WITH {RUNS} SELECT run_id, min_k, max_k, n_entries FROM rs WHERE min_k <= 'p00000005' AND max_k >= 'p00000005'")
def kv_run_prune(spark, sf):
    return runs.prune(item_runs(spark, sf), F.lit("p00000005")).select("run_id", "min_k", "max_k", "n_entries")


@query(f"WITH {RUNS} SELECT run_id, min_k, max_k, size_bytes FROM rs WHERE max_k >= 'p00000001' AND min_k <= 'p00000003'")
def kv_run_overlap(spark, sf):
    return runs.overlap(item_runs(spark, sf), F.lit("p00000001"), F.lit("p00000003")).select("run_id", "min_k", "max_k", "size_bytes")


@query(f"""WITH {RUNS}, probe AS (SELECT unnest(['p00000001', 'p00000004', 'p99999999']) AS k)
SELECT probe.k, rs.run_id FROM probe JOIN rs ON probe.k >= rs.min_k AND probe.k <= rs.max_k""")
def kv_run_candidates(spark, sf):
    probes = _keys(spark, "p00000001", "p00000004", "p99999999")
    return runs.candidates(probes, item_runs(spark, sf)).select("k", "run_id")


BLOCKS = f"""{LI}, sized AS (SELECT k, CAST(octet_length(encode(k)) + 17 AS BIGINT) AS s FROM newest),
b AS (SELECT k, CAST(floor(coalesce(sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096.0) AS BIGINT) AS block_id FROM sized),
ix AS (SELECT block_id, max(k) AS last_key, count(*) AS n_entries FROM b GROUP BY block_id)"""


def item_index(spark, sf):
    entries = resolve.latest(items(spark, sf), recency=TIES).select("k")
    return runs.block_index(runs.blocks(runs.key_ranked(entries), "ord"))


@query(f"WITH {BLOCKS} SELECT block_id, last_key, n_entries FROM ix")
def kv_block_index(spark, sf):
    return item_index(spark, sf)


@query(f"""WITH {BLOCKS}, probe AS (SELECT unnest(['p00000001', 'p00000150', 'p99999999']) AS k)
SELECT probe.k, min(ix.block_id) AS block_id FROM probe LEFT JOIN ix ON ix.last_key >= probe.k GROUP BY probe.k""")
def kv_index_lookup(spark, sf):
    probes = _keys(spark, "p00000001", "p00000150", "p99999999")
    return runs.index_lookup(probes, item_index(spark, sf))


@query("""WITH s AS (SELECT p_partkey AS n, 1e-4 AS p FROM part), m AS (SELECT n, CAST(floor(n * -ln(p) / (ln(2) * ln(2))) AS BIGINT) AS m FROM s)
SELECT n, m, CASE WHEN n <> 0 THEN CAST(floor(m / n) AS BIGINT) END AS k FROM m""")
def kv_bloom_sizing(spark, sf):
    n = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("n"))
    return n.withColumn("m", bloom.bits(F.col("n"), F.lit(1e-4))).withColumn("k", bloom.hashes(F.col("m"), F.col("n")))


@query(f"WITH {LI} SELECT k, TRUE AS maybe FROM newest UNION ALL SELECT 'absent keys, more than one in a hundred', FALSE")
def kv_bloom_members(spark, sf):
    """Every key is found; of as many keys that aren't there (in one row), hardly any."""
    keys = items(spark, sf).select("k").distinct()
    m, k = bloom.size(keys.count(), 1e-4)
    words = bloom.build(keys, m, k)
    found = bloom.might_contain(keys, words, m, k)
    absent = bloom.might_contain(keys.select(F.concat(F.lit("x"), "k").alias("k")), words, m, k)
    wrong = absent.agg((F.sum(F.col("maybe").cast("int")) * 100 > F.count("*")).alias("maybe"))
    return found.unionByName(wrong.select(F.lit("absent keys, more than one in a hundred").alias("k"), F.coalesce("maybe", F.lit(False)).alias("maybe")))


TIERS = """r AS (SELECT o_custkey AS run_id, CAST(count(*) * 700 AS BIGINT) AS size_bytes FROM orders GROUP BY o_custkey),
rt AS (SELECT r.run_id, r.size_bytes, c.c_nationkey AS tier_id FROM r JOIN customer c ON r.run_id = c.c_custkey)"""


def order_runs(spark, sf):
    """One run for each customer's orders, in a tier for each nation."""
    r = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("run_id")).agg((F.count("*") * 700).alias("size_bytes"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("run_id"), F.col("c_nationkey").alias("tier_id"))
    return r.join(c, "run_id").select("run_id", "size_bytes", "tier_id")


@query(f"""WITH {TIERS}, a AS (SELECT tier_id, CAST(floor(avg(size_bytes)) AS BIGINT) AS avg_size FROM rt GROUP BY tier_id)
SELECT run_id, size_bytes, avg_size, (avg_size * 0.5 < size_bytes AND size_bytes < floor(avg_size * 1.5)) OR (size_bytes < 4096 AND avg_size < 4096) AS fits FROM rt JOIN a USING (tier_id)""")
def kv_tier_fit(spark, sf):
    r = order_runs(spark, sf)
    a = tiering.averages(r).select("tier_id", "avg_size")
    return r.join(a, "tier_id").select("run_id", "size_bytes", "avg_size", tiering.fits(F.col("size_bytes"), F.col("avg_size")).alias("fits"))


@query(f"""WITH {TIERS}, n AS (SELECT *, count(*) OVER (PARTITION BY tier_id) AS n, row_number() OVER (PARTITION BY tier_id ORDER BY run_id) AS rk FROM rt)
SELECT tier_id, run_id, size_bytes FROM n WHERE n >= 4 AND rk <= 32""")
def kv_tier_imbalanced(spark, sf):
    return tiering.to_compact(order_runs(spark, sf), [F.col("run_id")]).select("tier_id", "run_id", "size_bytes")


def _newest_time(df):
    """The newest time of a log as a one-row column value, added to every row."""
    return df.withColumn("as_of", df.agg(F.max("created_at")).scalar())


def _compacted(spark, sf, cfg):
    return compaction.merge(_newest_time(items(spark, sf)), F.col("as_of"), cfg, recency=TIES).select("k", "v", "created_at", "is_tombstone")


@query(f"""WITH {LI}, m AS (SELECT max(created_at) AS as_of FROM li)
SELECT k, v, created_at, is_tombstone FROM newest, m WHERE NOT (is_tombstone AND created_at + INTERVAL 120 DAY < as_of)""")
def kv_compact_ttl(spark, sf):
    return _compacted(spark, sf, Config())


@query(f"""WITH {LI}, m AS (SELECT max(created_at) AS as_of FROM li) SELECT k, v, created_at, is_tombstone FROM newest, m
WHERE NOT (is_tombstone AND created_at + INTERVAL 120 DAY < as_of) AND NOT (NOT is_tombstone AND created_at + INTERVAL 365 DAY < as_of)""")
def kv_compact_entry_ttl(spark, sf):
    return _compacted(spark, sf, Config(enable_ttl=True, entry_ttl_ms=365 * DAY_MS))


TAIL, CHUNK = 300_000, 51_200
CLASS = f"""{LOG}, {NEWEST.format(src='lg')}, ch AS (SELECT * FROM lg WHERE voff >= {TAIL} AND voff < {TAIL + CHUNK}),
cl AS (SELECT ch.*, n.voff = ch.voff AND NOT n.is_tombstone AS valid FROM ch JOIN newest n ON ch.k = n.k)"""


@query(f"WITH {CLASS} SELECT valid, count(*) AS n, CAST(sum(rec_size) AS BIGINT) AS bytes FROM cl GROUP BY valid")
def kv_gc_classify(spark, sf):
    log = event_log(spark, sf)
    return reclaim.classify(changelog.chunk(log, TAIL, CHUNK), log).groupBy("valid").agg(F.count("*").alias("n"), F.sum("rec_size").alias("bytes"))


@query(f"WITH {CLASS} SELECT seq, k, voff, rec_size FROM cl WHERE NOT valid")
def kv_gc_reclaim(spark, sf):
    log = event_log(spark, sf)
    return reclaim.drop(changelog.chunk(log, TAIL, CHUNK), resolve.live(log)).select("seq", "k", "voff", "rec_size")


@query(f"WITH {CLASS} SELECT seq, k, v, created_at FROM cl WHERE valid")
def kv_gc_keep(spark, sf):
    log = event_log(spark, sf)
    return reclaim.keep(changelog.chunk(log, TAIL, CHUNK), resolve.live(log)).select("seq", "k", "v", "created_at")


@query(f"WITH {LOG} SELECT seq, k, voff FROM lg WHERE voff > 200000")
def kv_recover_replay(spark, sf):
    return changelog.replay(event_log(spark, sf), 200_000).select("seq", "k", "voff")


@query(f"""WITH {EV}, {NEWEST.format(src='ev')} SELECT k, CAST(json_extract_string(v, '$.k') AS INTEGER) AS field FROM newest WHERE NOT is_tombstone""")
def kv_json_value(spark, sf):
    return resolve.live(events(spark, sf)).select("k", F.from_json("v", "k int")["k"].alias("field"))


@query("""SELECT doc_id, coalesce(regexp_full_match(source, '[A-Za-z0-9_-]+') AND octet_length(encode(source)) BETWEEN 1 AND 255, FALSE) AS valid FROM documents""")
def kv_keyspace_valid(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", keyspace_valid(F.col("source")).alias("valid"))


@query("""SELECT doc_id, CASE WHEN coalesce(octet_length(encode(source)), 0) = 0 THEN 'KeySizeNone' WHEN octet_length(encode(source)) > 65536 THEN 'KeyMaxSizeExceeded'
WHEN coalesce(octet_length(encode(text)), 0) = 0 THEN 'ValueSizeNone' WHEN octet_length(encode(text)) > 4294967296 THEN 'ValueMaxSizeExceeded' ELSE 'ok' END AS verdict FROM documents""")
def kv_size_valid(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", size_class(F.col("source"), F.col("text")).alias("verdict"))


@query(f"""WITH {LOG}, {NEWEST.format(src='lg')}, al AS (SELECT * FROM newest WHERE NOT is_tombstone)
SELECT (SELECT count(*) FROM lg) AS n_records, (SELECT CAST(sum(rec_size) AS BIGINT) FROM lg) AS total_bytes, (SELECT count(*) FROM al) AS n_live, (SELECT CAST(sum(rec_size) AS BIGINT) FROM al) AS live_bytes""")
def kv_amplification(spark, sf):
    log = events(spark, sf).withColumn("rec_size", changelog.record_size())
    return reclaim.amplification(log, resolve.live(log))


@query(f"""WITH {EV}, m AS (SELECT to_timestamp(epoch(min(created_at)) + 0.5 * (epoch(max(created_at)) - epoch(min(created_at))))::TIMESTAMP AS at FROM ev),
old AS (SELECT ev.* FROM ev WHERE seq <= (SELECT max(seq) // 2 FROM ev)), {NEWEST.format(src='old')}
SELECT k, v, seq FROM newest WHERE NOT is_tombstone""")
def kv_as_of(spark, sf):
    """As of the record in the middle of the log."""
    log = events(spark, sf)
    half = log.agg(F.floor(F.max("seq") / 2)).scalar()
    at = log.where(F.col("seq") <= half).agg(F.max("created_at")).scalar()
    return resolve.as_of(log, at).select("k", "v", "seq")


@query(f"WITH {EV}, {NEWEST.format(src='ev')} SELECT k, v, seq FROM newest WHERE NOT is_tombstone")
def kv_stream_latest(spark, sf):
    """The same view, by a stream of the events file into a store."""
    from rivulet.functions.session import scratch_path
    from rivulet.sources.store import Store
    from rivulet.streaming.ingest import stream_into, stream_of_files

    store = Store.open(spark, "events", scratch_path(spark, "stream"))
    source = stream_of_files(spark, f"{sf}/events.parquet")
    gone = F.col("event_type") == "error"
    log = source.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).cast("binary").alias("k"),
        F.when(gone, F.lit("*")).otherwise(F.col("props")).cast("binary").alias("v"),
        F.col("ts").cast("timestamp").alias("created_at"),
        gone.alias("is_tombstone"),
    )
    stream_into(log, store, scratch_path(spark, "offsets"))
    return store.live().select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"), "seq")


@query(f"WITH {EV}, {NEWEST.format(src='ev')} SELECT k, v, seq FROM newest WHERE NOT is_tombstone")
def kv_store_cycle(spark, sf):
    """The same view after a store has put, flushed, compacted and reclaimed five batches of the events."""
    from rivulet.functions.session import scratch_path
    from rivulet.sources.store import Store

    store = Store.open(spark, "events", scratch_path(spark, "cycle"))
    log = events(spark, sf).select("seq", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"), F.col("created_at").cast("timestamp").alias("created_at"), "is_tombstone")
    top = log.agg(F.max("seq").alias("m")).first()["m"]
    for i in range(5):
        store.append(log.where((F.col("seq") > top * i // 5 - (i == 0)) & (F.col("seq") <= top * (i + 1) // 5)))
        store.flush()
    store.compact(as_of=None)
    store.reclaim()
    return store.live().select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"), "seq")


