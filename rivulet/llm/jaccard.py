"""Jaccard join of word n-gram sets by parity sketches.

Every document's set of shingles is cut by hash into parts, and the hashes in each part are XOR-ed: a sketch whose
number of differing parts bounds the symmetric difference from below. Two sets with Jaccard index J >= s and sizes a,
b differ in at most (a+b)(1-s)/(1+s) shingles, so with more non-empty parts than that at least one non-empty part is equal.
Documents meet on equal parts, per band of sizes; survivors of a size test and of a parity sketch (XOR of one
bit per shingle, in 1024 bits or more; Hamming distance against the same bound) are verified on their whole sets.

How it stays bounded. Equal sets count as one. Python tasks pack (part key, document) entries into blobs by bucket, which are worked off by ranges of keys; a key
that several documents of one batch share goes there once, and these documents' rows travel apart, dealt at random. Only keys
that occur again become rows. Each key's group is first linked through its best connected member; groups which then
still hold several components are compared in blocks of at most ``BLOCK`` documents. No group is ever collected
whole, none is cut, and a group's pairs are never all written.

Defined results: null texts and texts without a word have the empty set and link with nothing; texts with fewer
words than a shingle are one shingle; repeated rows and equal texts share a component; null ids are kept, and a
component without any other id has a null one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.session import drop_stored, stored
from rivulet.llm.common import join_spread, lists, mix64, ranges, task, utf8, word_hashes
from rivulet.llm.components import components

#: Documents of one block of a large group.
BLOCK = 512
#: Entries that a task gathers before it writes them out.
BATCH_KEYS, BATCH_DOCS = 300_000, 60_000
#: Key ranges in which a task compares what it was dealt, one after the other.
RANGES = 16
#: Hashes of whole sets that a task gathers before it sends them.
SET_VALUES = 200_000
#: Bits of the filter that keeps sets without candidates out of the shuffle: a fixed size, at worst it keeps none out.
FILTER_BITS, FILTER_HASHES = 1 << 23, 3
_U = np.uint64


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = word_hashes(utf8(text))
    if not len(h):
        return h
    width = min(size, len(h))
    out = np.zeros(len(h) - width + 1, _U)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out + h[i : len(h) - width + 1 + i] + _U(i + 1))
    return np.unique(out + _U(width != size)) if width != size else np.unique(out)


class Bands:
    """Groups of sizes that can meet, with the number of parts for each."""

    def __init__(self, percent: int):
        self.percent = percent

    def reach(self, total: int) -> int:
        """The greatest symmetric difference of two linked sets whose sizes add up to ``total``."""
        return total * (100 - self.percent) // (100 + self.percent)

    def groups(self, n: int) -> list[tuple[int, int]]:
        """(group, parts) of a set of n shingles: its band [2**i, 2**(i+1)) and a border within reach of it."""
        if n < 1 or self.reach(2 * n + 2) < 1 and self.reach(n + n * 100 // self.percent) < 1:
            return []
        i = n.bit_length() - 1
        out = [(2 * i, self.parts(2 * ((2 << i) - 1)))]
        for border in (1 << i, 2 << i):  # pairs with one size below the border
            low, high = -(-border * self.percent // 100), (border - 1) * 100 // self.percent
            if low <= n <= high and high >= border:
                out.append((2 * border.bit_length() + 1, self.parts(border - 1 + high)))
        return out

    def parts(self, total: int) -> int:
        d = self.reach(total)
        return d + 1 + 2 + d // 32

    def most(self, n: int) -> int:
        """The greatest symmetric difference to any partner."""
        return self.reach(n + n * 100 // self.percent)


def part_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys on which a set meets others. Empty parts only count where too few others are left for the guarantee."""
    out = []
    n = len(s)
    for group, parts in bands.groups(n):
        part = ((s >> _U(32)) * _U(parts)) >> _U(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        xor = np.bitwise_xor.reduceat(mix64(s), start)
        tag = mix64((_U(group) << _U(40)) | part[start])
        out.append(mix64(xor ^ tag))
        if len(start) <= bands.most(n):
            empty = np.setdiff1d(np.arange(parts, dtype=_U), part[start])
            out.append(mix64(mix64((_U(group) << _U(40)) | empty) + _U(1)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bits as longs: 1024 or, for larger sets, the power of two from twice their size on."""
    width = max(1024, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    """A shorter sketch of the same set: parities of equal remainders are XOR-ed."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, longs), 0)


def identity(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix64(s + _U(0x51ED270B)).sum(dtype=_U)
        b = np.bitwise_xor.reduce(mix64(s ^ _U(0xA5A5A5A55A5A5A5A))) if len(s) else _U(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


_META = "node long, id long, n long, h1 long, h2 long, sketch array<long>"
_ROW = f"bucket int, keys binary, nodes binary, {_META}"


def _mapped(key: str, text: str, size: int, percent: int, buckets: int):
    """Task: documents to blobs of keys, rows of keys shared in a batch, and one row of facts per document."""
    bands = Bands(percent)
    long = pa.int64()
    arrow = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), *((c, long) for c in ("node", "id", "n", "h1", "h2")), ("sketch", pa.list_(long))])

    def blobs(rows: list) -> pa.RecordBatch:
        own = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (1, 2))]
        return pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(rows), long) for _ in range(5)), pa.nulls(len(rows), pa.list_(long))], schema=arrow)

    def known(first: int, ids: pa.Array, sizes: list, signs: list, sketches: list) -> pa.RecordBatch:
        node = np.arange(first, first + len(ids))
        h = np.array(signs, np.int64).reshape(-1, 2)
        none = pa.nulls(len(ids), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array((-1 - node % buckets).astype(np.int32)), none, none, pa.array(node), ids, pa.array(sizes, long), pa.array(h[:, 0]), pa.array(h[:, 1]), lists(sketches)], schema=arrow)

    def flush(keys: list, nodes: list, turn: int) -> pa.RecordBatch:
        k = np.concatenate(keys)
        nd = np.repeat(np.array(nodes, np.int64), [len(x) for x in keys])
        order = np.argsort(k, kind="stable")
        k, nd = k[order], nd[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        single = head & np.concatenate([head[1:], [True]])
        rows = []
        shared = ~single
        for at in np.array_split(np.flatnonzero(shared), max(1, int(shared.sum()) // 4096)):
            if len(at):
                turn += 1
                rows.append((-1 - int(mix64(np.array([turn * 7919 + int(nd[at[0]])], _U))[0] % _U(buckets)), k[at], nd[at]))
        # One entry for each key; a shared key's stands for a document that has its row already (node -1).
        gk, gn = k[head], np.where(single, nd, -1)[head]
        bucket = (gk >> _U(20)) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        gk, gn, bucket = gk[order], gn[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for s, e in zip(cut, [*cut[1:], len(gk)]):
            rows.append((int(bucket[s]), gk[s:e], gn[s:e]))
        return blobs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers documents by partition and place: the same again if the task is run again.
        node = TaskContext.get().partitionId() << 40
        keys, nodes, total, turn, seen = [], [], 0, 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                first, sizes, signs, sketches = node, [], [], []
                for t in part.column(text):
                    s = shingles(t.as_py(), size)
                    h = identity(s)
                    sizes.append(len(s))
                    signs.append(h)
                    sketches.append(parity(s) if len(s) else np.zeros(0, np.int64))
                    if h not in seen:
                        k = part_keys(s, bands)
                        if len(k):
                            seen.add(h)
                            keys.append(k)
                            nodes.append(node)
                            total += len(k)
                    node += 1
                    if total >= BATCH_KEYS or len(nodes) >= BATCH_DOCS:
                        yield flush(keys, nodes, turn)
                        turn += total
                        keys, nodes, total, seen = [], [], 0, set()
                yield known(first, part.column(key), sizes, signs, sketches)
        if keys:
            yield flush(keys, nodes, turn)

    return task(run)


@task
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: blobs of sorted keys to rows of keys that occur again, one range of keys after the other; all else passes."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(k), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n), none, none, none, none, pa.nulls(len(k), pa.list_(pa.int64()))], schema=schema)

    held = []
    for b in batches:
        facts = b.filter(b.column("keys").is_null())
        if facts.num_rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(facts.num_rows, pa.int64()), *(facts.column(c) for c in ("node", "id", "n", "h1", "h2", "sketch"))], schema=schema)
        for bucket, k, n in zip(*(b.column(c) for c in ("bucket", "keys", "nodes"))):
            if not k.is_valid:
                continue
            k, n = np.frombuffer(k.as_py(), _U), np.frombuffer(n.as_py(), np.int64)
            if bucket.as_py() < 0:
                yield rows(k, n)
            else:
                held.append((k, n))
    for part in ranges(held, RANGES):
        k, n = (np.concatenate(x) for x in zip(*part))
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        twice = ~(head & np.concatenate([head[1:], [True]])) & (n >= 0)
        k, n = k[twice], n[twice]
        for at in range(0, len(k), 50_000):
            yield rows(k[at : at + 50_000], n[at : at + 50_000])


def _possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the tests on sizes and parity sketches."""
    f = facts.select("rep", "n", "sketch")
    x = f.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("x"))
    y = f.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where((100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for m, n, x, y in zip(b.column("an").to_pylist(), b.column("bn").to_pylist(), b.column("x"), b.column("y")):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                size = min(len(p), len(q))
                far = int(np.bitwise_count((folded(p, size) ^ folded(q, size)).view(_U)).sum())
                keep.append(far <= (m + n) * (100 - percent) // (100 + percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "an", "bn", "x", "y").mapInArrow(task(run), "a long, b long")


def _verified(source: DataFrame, pairs: DataFrame, members: DataFrame, size: int, percent: int, n: int, entries: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have the Jaccard index. Only members of pairs send their sets. n, entries: documents and keys in all."""
    pairs = stored(pairs, "jaccard-pairs", entries, 100_000)
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = stored(_sets(source, members.join(wanted, "rep", "left_semi").select("rep", "h1", "h2", "first_id"), size), "jaccard-sets", n, 5_000)
    x, y = (sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))  # row by row in the JVM: no batch of large sets
    like = (100 + percent) * shared >= percent * (F.size("set_a") + F.size("set_b"))
    links = stored(pairs.join(x, "a").join(y, "b").where(like).select("a", "b"), "jaccard-links", n, 5_000)
    drop_stored(pairs)
    drop_stored(sets)
    return links


def _tested(percent: int):
    """Task: of rows sorted by group, the pairs of different components that pass both tests, all groups side by side."""

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        col = {c: rows.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "rep", "n", "comp")}
        lists = rows.column("sketch").combine_chunks()
        flat, cut = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sketch = np.empty((len(lists), 16), np.int64)
        for size in np.unique(np.diff(cut)):
            here = np.flatnonzero(np.diff(cut) == size)
            sketch[here] = np.bitwise_xor.reduce(flat[(cut[here][:, None] + np.arange(size)).ravel()].reshape(len(here), -1, 16), 1)
        sketch = sketch.view(_U)
        new = np.concatenate([[True], (col["key"][1:] != col["key"][:-1]) | (col["lo"][1:] != col["lo"][:-1]) | (col["hi"][1:] != col["hi"][:-1])])
        group = np.cumsum(new)
        within, rep, n, comp, block = col["lo"] == col["hi"], col["rep"], col["n"], col["comp"], col["block"]
        at, step, out = np.arange(len(group)), 0, []
        while len(at):
            step += 1
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            to = at + step
            ok = (comp[at] != comp[to]) & (within[at] | (block[at] != block[to])) & (100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to]))
            i, j = at[ok], to[ok]
            ok = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= (n[i] + n[j]) * (100 - percent) // (100 + percent)
            out.append(np.stack([np.minimum(rep[i[ok]], rep[j[ok]]), np.maximum(rep[i[ok]], rep[j[ok]])], 1))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 4 * BLOCK:
                continue
            last = [rows.column(c)[rows.num_rows - 1].as_py() for c in ("key", "lo", "hi")]
            key, lo, hi = (rows.column(c).to_numpy() for c in ("key", "lo", "hi"))
            other = np.flatnonzero((key != last[0]) | (lo != last[1]) | (hi != last[2]))
            start = int(other[-1]) + 1 if len(other) else 0
            if start:
                yield pairs(rows.slice(0, start))
            held = rows.slice(start).to_batches()  # one group, which may go on: 2 * BLOCK rows at most
        if held:
            yield pairs(pa.Table.from_batches(held))

    return task(run)


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: key, n_shingles and component_id (the smallest key reachable by links)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    mapped = source.mapInArrow(_mapped("_id", "_text", size, percent, parts), _ROW).repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    met = stored(mapped.mapInArrow(_repeated, f"key long, {_META}"), "jaccard")

    # Equal sets count as one: their first node stands for all.
    facts = met.where("key IS NULL").drop("key")
    n = facts.count()
    reps = facts.groupBy("h1", "h2").agg(F.min("node").alias("rep"), F.count("*").alias("_rows"), F.min("id").alias("first_id")).withColumn("copies", F.col("_rows"))
    docs = join_spread(facts, reps, ["h1", "h2"], n)
    docs = stored(docs.select("node", "id", "n", "h1", "h2", "rep", "copies", "first_id", F.when(F.col("node") == F.col("rep"), F.col("sketch")).alias("sketch")), "jaccard-docs", n)
    rows = met.where("key IS NOT NULL").select("key", "node")
    entries = rows.count()
    mates = rows.join(docs.select("node", "rep"), "node").groupBy("key", "rep").agg(F.lit(1).alias("one")).select("key", "rep")
    # Keys with equal members make one group: members are compared by two sums over their hashes.
    signs = [F.bit_xor(F.xxhash64("rep")).alias("s1"), F.sum(F.shiftrightunsigned(F.xxhash64("rep", F.lit(1)), 24)).alias("s2")]
    counts = mates.groupBy("key").agg(F.count("*").alias("m"), *signs).where("m > 1")
    counts = counts.groupBy("m", "s1", "s2").agg(F.min("key").alias("key"), F.count("*").alias("keys")).select("key", "m", "keys", F.col("m").alias("_rows"))
    mates = stored(join_spread(mates, counts, "key", entries), "jaccard-groups", entries, 100_000)
    drop_stored(met)

    # Each group's hub is the member that meets most others.
    degree = mates.groupBy("rep").agg(F.sum(F.col("m") * F.col("keys")).alias("deg"))
    placed = mates.select("key", "rep", "m").join(degree, "rep")
    hubs = placed.groupBy("key").agg(F.max(F.struct("deg", F.negative("rep").alias("minus"))).alias("best"), F.first("m").alias("_rows")).select("key", F.negative("best.minus").alias("hub"), "_rows")
    stars = join_spread(placed, hubs, "key", entries).where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    members = docs.where("sketch IS NOT NULL").join(degree.select("rep"), "rep", "left_semi")
    members = stored(members.select("rep", "n", "h1", "h2", "sketch", "first_id"), "jaccard-members", n)
    links = _verified(source, _possible(stars, members, percent), members, size, percent, n, entries)
    first = components(links)

    # What the hubs left apart: groups that still hold several components. A pair's only link was tried already.
    named = mates.select("key", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    apart = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("_rows")).where("lo < hi AND _rows > 2").select("key", "_rows", F.ceil(F.col("_rows") / BLOCK).cast("int").alias("nb"))
    rest = join_spread(named, apart, "key", entries).join(members.select("rep", "n", "sketch"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "n", "comp", "sketch")
    dealt = dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = dealt.mapInArrow(_tested(percent), "a long, b long").distinct()
    late = _verified(source, _possible(more, members, percent), members, size, percent, n, entries)
    final = components(links.unionByName(late))
    for done in (first, mates, members, links, late):
        drop_stored(done)

    # The smallest id of each component, first among the different sets, then for their copies.
    sets = docs.where(F.col("node") == F.col("rep")).select("rep", "copies", "first_id")
    named = sets.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_rows"))
    labelled = join_spread(named, least, "comp", n).select("rep", "component_id", F.col("copies").alias("_rows"))
    out = join_spread(docs.select("id", "n", "rep"), labelled, "rep", n)
    lonely = F.col("n") == 0  # the empty set links with nothing, itself included
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(lonely, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _places(ids: np.ndarray) -> list[np.ndarray]:
    """Bits of the filter that stand for a document's id."""
    x = mix64(ids.view(_U))
    return [mix64(x + _U(i + 1)) % _U(FILTER_BITS) for i in range(FILTER_HASHES)]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


@task
def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for b in batches:
        for at in _places(_ids(b.column("first_id"))):
            bits[at] = True
    words = np.packbits(bits).view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["word", "mask"])


def _sets(source: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(rep, set): the whole sets of the members, from their texts. A filter of fixed size keeps most others out."""
    words = members.select("first_id").mapInArrow(_words_of, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    mask = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():  # FILTER_BITS / 64 rows at most
        mask[r["word"]] = r["mask"]
    shared = source.sparkSession.sparkContext.broadcast(mask.tobytes())

    def columns(rows: list) -> pa.RecordBatch:
        i, h1, h2, s = zip(*rows)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (i, h1, h2)), lists(list(s))], ["_id", "h1", "h2", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for b in batches:
            ids = _ids(b.column("_id"))
            maybe = np.logical_and.reduce([bits[p] for p in _places(ids)])
            out, total = [], 0
            for row in np.flatnonzero(maybe).tolist():
                s = shingles(b.column("_text")[row].as_py(), size)
                if len(s):
                    out.append((int(ids[row]), *identity(s), s.view(np.int64)))
                    total += len(s)
                if total > SET_VALUES:
                    yield columns(out)
                    out, total = [], 0
            if out:
                yield columns(out)

    found = source.mapInArrow(task(run), "_id long, h1 long, h2 long, set array<long>")
    found = found.join(members.select("rep", "h1", "h2", "first_id"), ["h1", "h2"])
    return found.where(F.col("_id") == F.coalesce("first_id", F.lit(-1))).dropDuplicates(["rep"]).select("rep", "set")
