"""Passages that stood earlier in the corpus, by run-length indexes.

A byte is repeated if a string of ``length`` bytes around it also starts earlier (in a document of smaller key, or in the
same one). Equal texts count once: a later copy is repeated as a whole.

Every string of that length has an anchor, the smallest hash of a k-mer in it; equal strings have equal anchors, and a run
of strings with one anchor goes together. A hot anchor, one that stands in a large share of all runs, is split: its strings are told apart
by where the anchor stands in them, in ``SIDES`` steps, and by the bytes that all strings of such a step have in common. Python tasks pack anchors into blobs by bucket, and only anchors that occur again
go on, each with the snippet of text that its run of strings covers. Snippets of the same anchors meet in one task, which
concatenates them in document order, builds the run-compressed Burrows-Wheeler transform of the whole and keeps, of the suffix
array, only samples at the run boundaries. From these it streams the matching statistics of the text against itself:
at each place the length of the longest match with the lexicographic neighbour, and where that is. Matches of
``length`` or more chain equal strings; all but the first of a chain are marked.

How it stays bounded: an anchor or snippet that several documents of a batch share goes on once, and what is known to be
repeated then travels apart, dealt at random; a run of strings is cut every ``RUN`` places, so that periodic texts become equal
snippets; blobs are worked off by ranges of anchors, and a task's index covers about ``INDEX_BYTES`` (one anchor's snippets
at least). Texts move once by key and are reused from that shuffle. A document is known by its key and a hash of its text,
without a key by two hashes: 128 bits.

Defined results: null texts are empty; texts shorter than ``length`` have no repeated byte; bytes are those of UTF-8; null keys
come after all others; rows equal in key and text count as one document and get equal results, equal keys with
different texts are put in order by a hash; further columns pass through whatever their names, ``spans`` is replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.session import drop_stored, stored
from rivulet.llm.common import mix64, prefix_hash, ranges, set_apart, sorted_places, span_hash, task, utf8

#: Bytes of an anchor, of a piece of a very long text, and of the text of one index.
KMER, PIECE, INDEX_BYTES = 32, 1 << 18, 1 << 18
#: Strings of a run that go together: a few times the longest period that one anchor can cover.
RUN = 1 << 14
#: Anchors, snippets and bytes of snippets that a task gathers before it writes them out.
BATCH, SNIPPETS, SNIPPET_BYTES = 250_000, 20_000, 4 << 20
#: Key ranges in which a task compares the anchors that it was dealt, one after the other.
RANGES = 8
#: Parts that the strings of a hot anchor are split into by the anchor's place in them.
SIDES = 4
#: An anchor is hot if it has this many runs, and one of this many equal shares of a partition's runs.
HOT, HOT_SHARES = 1_000, 8
_U = np.uint64


def anchors(data: np.ndarray, length: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of one anchor: first starts, ends of the starts, anchors, and whether strings of the run can be equal.

    Equal strings have their anchor at the same distance, so in a run with equal ones it stands at several places. Runs
    of the anchors ``hot`` are split by that distance, and named by the bytes that all strings of the part share.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool)
    width = length - KMER + 1
    step = -(-width // SIDES)
    firsts, hashes, several = [], [], []
    for start in range(0, n, PIECE):
        part = data[start : min(len(data), start + PIECE + length - 1)]
        k = np.arange(len(part) - KMER + 1)
        prefix = prefix_hash(part)
        h = span_hash(prefix, k, k + KMER)
        low = (h & ~_U(0xFFFFFF)) | k.astype(_U)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        at = (low & _U(0xFFFFFF)).astype(np.int64)
        low = h[at]
        new = np.concatenate([[True], low[1:] != low[:-1]])
        new[RUN - 1 - (start - 1) % RUN :: RUN] = True
        first = np.flatnonzero(new)
        if hot is not None and (split := np.isin(mix64(low[first]), hot)).any():
            i = np.flatnonzero(np.repeat(split, np.diff(np.append(first, len(low)))))
            side = (at[i] - i) // step
            shared = at[i] - side * step
            low[i] = mix64(low[i] + side.astype(_U)) ^ span_hash(prefix, shared, shared + length - step + 1)
            new[1:] |= low[1:] != low[:-1]
            first = np.flatnonzero(new)
        firsts.append(first + start)
        hashes.append(low[first])
        several.append(at[first] != at[np.append(first[1:], len(at)) - 1])
    f, h = np.concatenate(firsts), np.concatenate(hashes)
    return f, np.append(f[1:], n), mix64(h), np.concatenate(several)  # smallest hashes lie close together: mixed again


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of some strings, each with an end of its own, with samples at run heads."""

    def __init__(self, strings: list[bytes], least: int = 0):
        """``least``: matches shorter than that may be given as shorter still."""
        sizes = np.array([len(s) + 1 for s in strings])
        ends = np.cumsum(sizes) - 1
        text = np.frombuffer(b"\x00".join([*strings, b""]), np.uint8).astype(np.int32) + np.int32(len(strings))
        text[ends] = np.arange(len(strings))
        self.starts, self.n = np.cumsum(sizes) - sizes, len(text)
        order, ranks = self._suffixes(text, len(strings))
        left = np.where(order > 0, text[order - 1], -1)
        head = np.concatenate([[True], left[1:] != left[:-1]])
        at = np.flatnonzero(head)
        here, other = order[at], order[np.maximum(at - 1, 0)]
        match = np.zeros(len(at), np.int64)
        long = at > 0
        for depth, rank in ranks:
            if depth <= least:
                long[long] = rank[here[long]] == rank[other[long]]
        match[long] = self._common(text, ranks, here[long], other[long])
        #: Symbols and lengths of the runs; then, by place in the text, the sampled heads, their neighbours and matches.
        self.runs = (left[at], np.diff([*at, len(order)]))
        by = np.argsort(here)
        self.sampled, self.neighbour, self.match = here[by], other[by], match[by]

    @staticmethod
    def _suffixes(text: np.ndarray, strings: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order by doubling, and the ranks at each depth. Ends differ, so no depth beyond a string is needed.

        The first depth packs symbols, ends as zero, and the number of the end that follows within it.
        """
        n = len(text)
        used = np.flatnonzero(np.bincount(np.maximum(text - strings, -1) + 1, minlength=257)[1:])
        dense = np.zeros(257, np.uint16)
        dense[used + 1] = np.arange(1, len(used) + 1)
        symbol = dense[np.maximum(text - strings, -1) + 1]
        bits, more = int(len(used)).bit_length(), int(strings).bit_length()
        wide = 63 - n.bit_length()  # bits of a key beside its place
        depth = max(1, (max(wide, 32) - more) // max(bits, 1))
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        end = np.zeros(n, np.int32)
        for i in range(depth):
            key <<= bits
            here = open_[: n - i]
            key[: n - i] |= np.where(here, symbol[i:], 0)
            ends = here & (symbol[i:] == 0)
            end[: n - i] += np.where(ends, text[i:] + 1, 0)
            open_[: n - i] &= ~ends
        key = (key << more) | end
        del symbol, open_, end
        ranks = []
        while True:
            k, order = sorted_places(key.view(_U), int(key.max()).bit_length())
            new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            rank = np.empty(n, np.int32)  # an index is far smaller than 2**31
            rank[order] = new
            ranks.append((depth, rank))
            if new[-1] == n - 1:
                return order, ranks
            key = rank.astype(np.int64) * (n + 1)
            key[: n - depth] += rank[depth:] + 1
            depth *= 2

    @staticmethod
    def _common(text: np.ndarray, ranks: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes at a and b: equal ranks, from the greatest depth down."""
        out, n = np.zeros(len(a), np.int64), len(text)
        for depth, rank in reversed(ranks):
            while True:
                i, j = a + out, b + out
                inside = (i < n) & (j < n) & (a != b)
                same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
                out += depth * same
                if depth != ranks[0][0] or not same.any():
                    break
        for _ in range(ranks[0][0]):
            i, j = a + out, b + out
            out += (i < n) & (j < n) & (a != b) & (text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)])
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the text the longest match with its lexicographic neighbour, and the neighbour's place.

        Away from run heads both follow from the last sampled place: the match is shorter by the distance.
        """
        place = np.arange(self.n)
        last = np.searchsorted(self.sampled, place, side="right") - 1
        gone = place - self.sampled[last]
        return self.match[last] - gone, self.neighbour[last] + gone

    def repeated(self, length: int) -> np.ndarray:
        """Whether the string of ``length`` at each place has also begun earlier."""
        match, neighbour = self.statistics()
        linked = np.flatnonzero(match >= length)
        out = np.zeros(self.n, bool)
        if not len(linked):
            return out
        root = np.arange(self.n)
        root[linked] = neighbour[linked]
        while True:
            up = root[root[linked]]
            if (up == root[linked]).all():
                break
            root[linked] = up
        least = np.arange(self.n)
        np.minimum.at(least, root[linked], linked)
        out[linked] = linked != least[root[linked]]
        heads = np.unique(root[linked])
        out[heads] = heads != least[heads]
        return out


def _frequent(text: str, length: int, most: int):
    """Task: (key, n), the anchors of more than one in ``most`` runs of the task, by Misra-Gries; and all runs under a null key.

    A count is short by one in ``most`` of the task's runs at most, and no more than ``most`` anchors are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, total = np.zeros(0, _U), np.zeros(0, np.int64), 0

        def folded(new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            k, c = np.unique(np.concatenate(new), return_counts=True)
            both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([n, c]), len(both)).astype(np.int64)
            if len(sums) > most:
                sums -= np.partition(sums, len(sums) - most - 1)[len(sums) - most - 1]
            return both[sums > 0], sums[sums > 0]

        waiting, size = [], 0
        for b in batches:
            for t in b.column(text):
                waiting.append(anchors(np.frombuffer(utf8(t.as_py()), np.uint8), length)[2])
                size += len(waiting[-1])
                if size >= BATCH:
                    keys, n = folded(waiting)
                    total, waiting, size = total + size, [], 0
        if size:
            keys, n = folded(waiting)
            total += size
        keep = n * most > total
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys[keep].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[keep].tolist()], pa.int64())], ["key", "n"])

    return task(run)


def hot_anchors(df: DataFrame, text: str, length: int) -> np.ndarray:
    """The anchors whose runs would be a large part of a partition, over all texts.

    Their number grows with the partitions, not with the rows: ``HOT_SHARES`` for each at most, as every one stands for
    its share of the runs. Tasks' counts may be short by half of that share, so the half is asked for.
    """
    shares = HOT_SHARES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(df.select(text).mapInArrow(_frequent(text, length, 2 * shares), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "anchors")
    total = counts.where("key IS NULL").first()
    least = max(HOT, (total["n"] if total else 0) // (2 * shares))
    found = counts.where("key IS NOT NULL").where(F.col("n") >= least).select("key").collect()  # 2 * shares at most
    drop_stored(counts)
    return np.sort(np.array([r["key"] for r in found], np.int64).view(_U))


def _anchored(text: str, length: int, buckets: int, hot: np.ndarray):
    """Task: anchors to blobs by bucket; anchors shared within a batch have rows of their own, dealt at random."""

    def flush(keys: list, docs: list, places: list, several: list, turn: int) -> Iterator[pa.RecordBatch]:
        k, d, p = np.concatenate(keys), np.repeat(np.array(docs, np.int64), [len(x) for x in keys], axis=0), np.concatenate(places).astype(np.int32)
        order = np.argsort(k, kind="stable")
        k, d, p = k[order], d[order], p[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        single = head & np.concatenate([head[1:], [True]]) & ~np.concatenate(several)[order]
        rows = []
        shared = np.flatnonzero(~single)
        for i, at in enumerate(np.array_split(shared, max(1, len(shared) // 8192))):
            if len(at):
                rows.append((-1 - int(mix64(np.array([int(d[at[0], 1]) % (1 << 62) + turn + i], _U))[0] % _U(buckets)), b"", d[at].tobytes(), p[at].tobytes()))
        k, d, p, lone = k[head], d[head], p[head], single[head]
        bucket = (k >> _U(16)) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        k, d, p, bucket = k[order], d[order], np.where(lone, p, -1)[order].astype(np.int32), bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for s, e in zip(cut, [*cut[1:], len(k)]):
            rows.append((int(bucket[s]), k[s:e].tobytes(), d[s:e].tobytes(), p[s:e].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["bucket", "keys", "docs", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, several, total, turn = [], [], [], [], 0, 0
        done: set[tuple[int, int]] = set()  # equal rows lie in one partition and count as one document
        for b in batches:
            for d, t in zip(zip(b.column("d1").to_pylist(), b.column("d2").to_pylist()), b.column(text)):
                if d in done:
                    continue
                done.add(d)
                first, _, h, more = anchors(np.frombuffer(utf8(t.as_py()), np.uint8), length, hot)
                for at in range(0, len(first), BATCH):
                    keys.append(h[at : at + BATCH])
                    docs.append(d)
                    places.append(first[at : at + BATCH])
                    several.append(more[at : at + BATCH])
                    total += len(keys[-1])
                    if total >= BATCH:
                        yield from flush(keys, docs, places, several, turn)
                        turn += total
                        keys, docs, places, several, total = [], [], [], [], 0
        if keys:
            yield from flush(keys, docs, places, several, turn)

    return task(run)


@task
def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: of blobs of sorted anchors those that occur again, as (d1, d2, place), one range of anchors after the other."""

    def rows(d: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(d), 50_000):
            part = slice(s, s + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(d[part, 0]), pa.array(d[part, 1]), pa.array(p[part])], ["d1", "d2", "place"])

    held = []
    for b in batches:
        for bucket, k, d, p in zip(*(b.column(c) for c in ("bucket", "keys", "docs", "places"))):
            d, p = np.frombuffer(d.as_py(), np.int64).reshape(-1, 2), np.frombuffer(p.as_py(), np.int32)
            if bucket.as_py() < 0:
                yield from rows(d, p)
            else:
                held.append((np.frombuffer(k.as_py(), _U), d, p))
    for part in ranges(held, RANGES):
        k, d, p = (np.concatenate(x) for x in zip(*part))
        order = np.argsort(k, kind="stable")
        k = k[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        again = order[~(head & np.concatenate([head[1:], [True]]))]
        again = again[p[again] >= 0]
        yield from rows(d[again], p[again])


_MARK = ["key", "ord", "d1", "d2", "start", "stop", "snippet"]


def _snippets(text: str, length: int, hot: np.ndarray):
    """Task: the snippets of repeated anchors; those that stood earlier in the batch as marks already."""

    def flush(found: list) -> Iterator[pa.RecordBatch]:
        found.sort(key=lambda r: r[:4])
        seen: set[tuple[int, bytes]] = set()
        rows = []
        for o, d1, d2, s, e, key, snippet in found:
            if (key, snippet) in seen:
                rows.append((d2 ^ (s * 0x9E3779B1), o, d1, d2, s, e, None))  # known already: dealt anywhere
            else:
                seen.add((key, snippet))
                rows.append((key, o, d1, d2, s, e, snippet))
        for at in range(0, len(rows), 10_000):
            part = list(zip(*rows[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([*(pa.array(part[i], pa.int64()) for i in range(6)), pa.array(part[6], pa.binary())], _MARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        done: set[tuple[int, int]] = set()
        for b in batches:
            for d1, d2, o, t, want in zip(*(b.column(c).to_pylist() for c in ("d1", "d2", "ord")), b.column(text), b.column("places")):
                if (d1, d2) in done:
                    continue
                done.add((d1, d2))
                x = utf8(t.as_py())
                first, stop, h, _ = anchors(np.frombuffer(x, np.uint8), length, hot)
                for i in np.flatnonzero(np.isin(first, want.values.to_numpy())):
                    s, e = int(first[i]), int(stop[i])
                    found.append((o, d1, d2, s, e, int(h[i].view(np.int64)), x[s : e + length - 1]))
                    size += e - s + length
                    if len(found) >= SNIPPETS or size >= SNIPPET_BYTES:
                        yield from flush(found)
                        found, size = [], 0
        if found:
            yield from flush(found)

    return task(run)


def _marked(length: int):
    """Task: rows sorted by anchor; an index over the snippets of some anchors at a time; marks (d1, d2, start, stop)."""
    names = ["d1", "d2", "start", "stop"]

    def index(rows: pa.Table) -> pa.RecordBatch:
        o, d1, d2, s, stop = (rows.column(c).to_numpy() for c in ("ord", *names))
        snippets = rows.column("snippet").to_pylist()
        # Of equal snippets the first is indexed; all strings of the others have been seen in it.
        firsts: dict[bytes, int] = {}
        later = []
        for i in np.lexsort((s, d2, d1, o)).tolist():
            if firsts.setdefault(snippets[i], i) != i:
                later.append(i)
        order = np.fromiter(firsts.values(), np.int64, len(firsts))
        found = RunIndex(list(firsts), length)
        bad = found.repeated(length)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], bad.view(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        which = np.searchsorted(found.starts, begin, side="right") - 1
        row = order[which]
        shift = s[row] - found.starts[which]
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([x[row], x[later]])) for x in (d1, d2)), pa.array(np.concatenate([begin + shift, s[later]])), pa.array(np.concatenate([end + shift, stop[later]]))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            known = b.column("snippet").is_null()
            if known.true_count:
                done = b.filter(known)
                yield pa.RecordBatch.from_arrays([done.column(c) for c in names], names)
                b = b.filter(b.column("snippet").is_valid())
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("snippet").nbytes
            if size < INDEX_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            last = np.flatnonzero(key[1:] != key[:-1])
            if len(last):
                cut = int(last[-1]) + 1
                yield index(rows.slice(0, cut))
                held = [pa.RecordBatch.from_pylist(rows.slice(cut).to_pylist(), rows.schema)]  # a copy, so that the rest is freed
                size = held[0].column("snippet").nbytes
        if held:
            yield index(pa.Table.from_batches(held))

    return task(run)


SPANS = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, fields: list[T.StructField] | None = None, answer: Callable[[str | None, list[dict]], tuple] | None = None) -> DataFrame:
    """Appends spans: sorted, disjoint byte ranges (start, stop) of the text that are repeated.

    For callers that need something made of text and spans: ``fields`` instead, with what ``answer(text, spans)`` gives for
    them, in the same pass; columns of their names are replaced.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields, answer = (fields, answer) if fields else ([SPANS], lambda _, spans: (spans,))
    plain, name, back = set_apart(df, *(f.name for f in fields))
    at, own = name[text], [c for c, _ in back]
    read = list(dict.fromkeys([*own, at]))
    body, id_ = F.coalesce(F.col(at), F.lit("")), F.col(name[key]).cast("long")
    hashed = lambda seed: F.xxhash64(F.lit(seed), body)  # noqa: E731  the seed first: hashes that are independent
    named = plain.withColumn("ord", F.coalesce(id_, F.lit(2**63 - 1))).withColumn("d1", F.coalesce(id_, hashed(1))).withColumn("d2", hashed(2))
    # The first document of each text; later copies take no part.
    same = F.struct(hashed(3), "d2", F.octet_length(body))
    first = named.groupBy(same.alias("same")).agg(F.min(F.struct("ord", "d1", "d2")).alias("f")).select("f.d1", "f.d2", F.lit(True).alias("first"))
    hot = hot_anchors(plain, at, length)
    # The one shuffle of texts. All that follows reads the same columns of it, so that it is reused.
    columns = [*read, "ord", "d1", "d2"]
    flagged = named.select(*columns).repartition(parts, "d1", "d2").join(first.hint("shuffle_hash"), ["d1", "d2"], "left")
    firsts = flagged.where("first").select(*columns)
    blobs = firsts.mapInArrow(_anchored(at, length, parts, hot), "bucket int, keys binary, docs binary, places binary")
    blobs = blobs.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    again = blobs.mapInArrow(_again, "d1 long, d2 long, place int").groupBy("d1", "d2").agg(F.collect_set("place").alias("places"))
    found = firsts.join(again.hint("shuffle_hash"), ["d1", "d2"]).select(*columns, "places").mapInArrow(_snippets(at, length, hot), "key long, ord long, d1 long, d2 long, start long, stop long, snippet binary")
    dealt = found.repartition(parts, "key").sortWithinPartitions("key")
    marks = dealt.mapInArrow(_marked(length), "d1 long, d2 long, start long, stop long")
    each = marks.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    whole = flagged.join(each.hint("shuffle_hash"), ["d1", "d2"], "left")
    keep = T.StructType([plain.schema[c] for c in own])

    made = T.StructType([T.StructField(f"x{i}", f.dataType) for i, f in enumerate(fields)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(made)
        for b in batches:
            rows = []
            for t, is_first, m in zip(b.column(at), b.column("first").to_pylist(), b.column("marks")):
                t = t.as_py()
                if is_first:
                    spans = joined([(x["start"], x["stop"] + length - 1) for x in m.as_py() or ()])
                else:
                    n = len(utf8(t))
                    spans = [{"start": 0, "stop": n}] if n >= length else []
                rows.append(answer(t, spans))
            new = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + [pa.array(x, kinds.field(i).type) for i, x in enumerate(new)], names=[*own, *kinds.names])

    done = whole.select(*columns, "first", "marks").mapInArrow(task(finish), T.StructType([*keep, *made]))
    return done.select(*(F.col(c).alias(n) for c, n in back), *(F.col(f"x{i}").alias(f.name) for i, f in enumerate(fields)))


def joined(ranges: list[tuple[int, int]]) -> list[dict]:
    """The union of byte ranges; ranges that touch become one."""
    out: list[dict] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], e)
        else:
            out.append({"start": s, "stop": e})
    return out


def rest(text: bytes, spans: list[dict] | None) -> bytes:
    """What is left of a text without its spans."""
    at, out = 0, []
    for s in spans or ():
        out.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, text[at:]])
