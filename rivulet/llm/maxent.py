"""Language-model scoring by counted word n-grams over a class-factored maximum-entropy model.

The probability of a token mixes, from the widest context to the narrowest, the counts of word triples, of word pairs and
of word pairs that skip a place with the probability of the narrower contexts (Dirichlet smoothing, so that the
probabilities after any context add up, to 1 at most). In log-linear terms a gram seen c times has the weight log(1 + c / (a p)) over
the narrower p, and its context the normaliser 1 + n / a: sparse features of words, in closed form. These grams are counted over all training texts by hash, in a space of 64
places per byte of text: none is dropped, and space and counts grow with the corpus. Below them stands the probability of the
token's class times that of the token within its class.
The class comes from a softmax of fixed size over weights of hashed features: the buckets of the two words before, pairs
of classes before and pairs and triples that skip places. Within a class, token counts of the whole training corpus are
smoothed by one.

Classes are found from the corpus: words are dealt into buckets by their last four bytes, each bucket's neighbours in
all training texts are counted, and buckets with like neighbours are put together (k-means over a table of fixed
size). The end of a text is a class of its own. Training runs in rounds over disjoint parts of the training texts that
together hold them all: every task takes the weights so far, makes its own gradient steps (Adagrad) in batches, and the
tasks' weights are averaged by tokens.

Counts of words (50 bits of a hash and the bucket) and grams are shared by chunks of text: a chunk sends each of its keys once with its own
count, sorted and cut by key range into shards; a shard adds up the counts and sends the sums back in the order of the
chunk's keys, where they meet the chunk's texts again. No key comes more often than there are chunks, however common it is.

Defined results: null and empty texts are one end token; without training texts every token is unknown and the score is
the base score; repeated rows get equal results; null ids are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.session import stored
from rivulet.llm.common import _LOWER, mix64, prefix_hash, sorted_places, span_hash, task, utf8, word_spans

CLASSES = 24
BUCKETS = 8192
NEIGHBOURS = 64
FEATURES = 1 << 14
SLOTS = 6
ROUNDS = 2
STEP = 0.25
#: Tokens of a training batch, and bytes of text that are taken through the arrays at once.
BATCH, BYTES = 16_384, 1 << 19
#: Bytes of text of a chunk, and of text whose keys a shard holds on average.
CHUNK = 1 << 22
#: Bits of a gram's key beyond those that number the bytes of all texts: 2**PLACES places a byte.
PLACES = 6
#: Weight of the narrower context, in tokens, for pairs and for triples.
NARROW = (30.0, 8.0)
#: Bits of a word's key that hold its bucket.
BUCKET_MASK = (1 << 14) - 1
END = np.uint64(0xE0E0E0E0E0E0E0E1)
#: What stands one and two places before a text.
START, START2 = np.uint64(0xA1A1A1A1A1A1A1A3), np.uint64(0xB2B2B2B2B2B2B2B5)
_U = np.uint64


@dataclass
class Tokens:
    """Tokens of some texts, an end after each: hashes, buckets (BUCKETS for an end), and each token's place in its text."""

    hash: np.ndarray
    bucket: np.ndarray
    place: np.ndarray
    doc: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    start, stop = word_spans(data)
    h = span_hash(prefix_hash(data), start, stop)
    # The last four bytes of each word as one number, zeros before shorter words.
    four = np.ndarray(len(data) + 1, "<u4", np.concatenate([np.zeros(4, np.uint8), data]), strides=1)
    short = (8 * np.maximum(4 - (stop - start), 0)).astype(np.uint32)
    last = four[stop] >> short << short
    b = (mix64(last.astype(_U)) % _U(BUCKETS)).astype(np.int32)
    upto = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    size = np.diff(upto, prepend=0) + 1
    end = np.cumsum(size) - 1
    word = np.ones(int(size.sum()), bool)
    word[end] = False
    hashes, buckets = np.full(len(word), END), np.full(len(word), BUCKETS, np.int32)
    hashes[word], buckets[word] = h, b
    return Tokens(hashes, buckets, np.arange(len(word)) - np.repeat(end + 1 - size, size), np.repeat(np.arange(len(texts)), size))


def _groups(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts together, about BYTES at once, a longer text alone: arrays that stay small."""
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > BYTES:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for texts in _groups(utf8(t.as_py()) for b in batches for t in b.column("_text")):
        yield tokens(texts)


#: Blocks in which the neighbour table goes to be added up.
BLOCKS = 64


@task
def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: for each bucket its neighbours and, in a column of their own, its tokens, in blocks (block, table)."""
    wide = NEIGHBOURS + 1
    around = np.zeros((BUCKETS + BLOCKS) * wide, np.int64)
    for t in _read(batches):
        near = (t.hash % _U(NEIGHBOURS)).astype(np.int64)
        at = t.bucket.astype(np.int64) * wide
        cells = [at + NEIGHBOURS]
        for lag in (1, 2, 3):
            ok = t.place[lag:] >= lag
            cells += [(at[lag:] + near[:-lag])[ok], (at[:-lag] + near[lag:])[ok]]
        around += np.bincount(np.concatenate(cells), minlength=len(around))
    table = around.reshape(BLOCKS, -1)
    full = [i for i in range(BLOCKS) if table[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([table[i].tobytes() for i in full], pa.binary())], ["block", "table"])


def _summed(kind: str):
    """Task: tables of the same block added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, t in zip(b.column("block").to_pylist(), b.column("table").to_pylist()):
                x = np.frombuffer(t, kind)
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "table"])

    return task(run)


def _added(df: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """The sum of each block's tables, in two steps where there are many: in groups first, one task each, then of the groups."""
    fan = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BLOCKS)
    group = (F.col("block") * fan + F.pmod(F.xxhash64("table"), F.lit(fan))).cast("int")
    part = df.select("block", "table").repartitionById(BLOCKS * fan, group).mapInArrow(_summed(kind), "block int, table binary")
    rows = part.repartitionById(BLOCKS, F.col("block")).mapInArrow(_summed(kind), "block int, table binary").collect()  # one fixed-size table per block
    return {r["block"]: np.frombuffer(r["table"], kind) for r in rows}


def cluster(around: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Class of each bucket: k-means over the square roots of neighbour shares, weighted by counts."""
    total = around.sum(1)
    used = np.flatnonzero(total)
    out = np.zeros(len(around), np.int64)
    if not len(used):
        return out
    x = np.sqrt(around[used] / total[used, None])
    w = np.sqrt(total[used])
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), k, p=w / w.sum())]
    for _ in range(30):
        at = (-2 * x @ book.T + (book**2).sum(1)[None]).argmin(1)
        mass = np.bincount(at, w, k)
        new = np.zeros_like(book)
        np.add.at(new, at, x * w[:, None])
        live = mass > 0
        book[live] = new[live] / mass[live, None]
    out[used] = at
    return out


def features(t: Tokens, classes: np.ndarray) -> np.ndarray:
    """Hashed features (tokens x SLOTS) of what stands before each token."""

    def before(x: np.ndarray, lag: int, none: int) -> np.ndarray:
        out = np.full(len(x), none, np.int64)
        out[lag:] = x[:-lag]
        out[t.place < lag] = none
        return out

    b1, b2 = before(t.bucket, 1, BUCKETS + 1), before(t.bucket, 2, BUCKETS + 1)
    c = [before(classes, lag, CLASSES) for lag in range(1, 8)]
    wide = CLASSES + 1
    slots = [b1, b2, c[0] * wide + c[1], c[0] * wide + c[2], c[1] * wide + c[3], (c[2] * wide + c[4]) * wide + c[6]]
    with np.errstate(over="ignore"):
        return np.stack([(mix64(s.astype(_U) + _U((i + 1) << 40)) % _U(FEATURES)).astype(np.int64) for i, s in enumerate(slots)], 1)


def logits(weights: np.ndarray, bias: np.ndarray, ids: np.ndarray) -> np.ndarray:
    z = bias + weights[ids[:, 0]]
    for j in range(1, SLOTS):
        z += weights[ids[:, j]]
    z -= z.max(1, keepdims=True)
    return z


def log_softmax(weights: np.ndarray, bias: np.ndarray, ids: np.ndarray) -> np.ndarray:
    z = logits(weights, bias, ids)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class Model:
    class_of: np.ndarray  # by bucket, the end's last
    weights: np.ndarray
    bias: np.ndarray


def _trained(model: Model):
    """Task: gradient steps over its own texts; weights times tokens, in one row per block of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, scale, seen = model.weights.copy(), np.full(FEATURES, 1e-2, np.float32), 0
        for t in _read(batches):
            classes = model.class_of[t.bucket]
            ids = features(t, classes)
            for s in range(0, len(classes), BATCH):
                i, y = ids[s : s + BATCH], classes[s : s + BATCH]
                g = np.exp(logits(w, model.bias, i))
                g /= g.sum(1, keepdims=True)
                g[np.arange(len(y)), y] -= 1
                for j in range(SLOTS):
                    short = i[:, j].astype(np.uint16)  # sorted by digits
                    order = np.argsort(short, kind="stable")
                    key = short[order]
                    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    rows, size = key[cut], np.diff([*cut, len(key)])
                    step = np.add.reduceat(g[order], cut, axis=0) / size[:, None].astype(np.float32)
                    scale[rows] += (step**2).mean(1) * size / 100
                    w[rows] -= STEP / SLOTS * step * np.minimum(1, size / 20).astype(np.float32)[:, None] / np.sqrt(0.05 + scale[rows])[:, None]
            seen += len(classes)
        if seen:
            table = np.concatenate([(w.astype(np.float64) * seen).reshape(BLOCKS, -1), np.full((BLOCKS, 1), float(seen))], 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in table], pa.binary())], ["block", "table"])

    return task(run)


def words(t: Tokens) -> np.ndarray:
    """Key of each token: a hash, with the bucket in the last bits."""
    return (t.hash & ~_U(BUCKET_MASK)) | t.bucket.astype(_U)


def grams(t: Tokens, wide: int = 64) -> np.ndarray:
    """Keys of ``wide`` bits (3 x tokens): the pair, the pair over one place, the triple."""

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mix64(x * _U(0x9E3779B97F4A7C15) + y)

    w1, w2 = np.full(len(t.hash), START), np.full(len(t.hash), START2)
    w1[1:], w2[2:] = t.hash[:-1], t.hash[:-2]
    w1[t.place < 1], w2[t.place < 2] = START, START
    w2[t.place < 1] = START2
    with np.errstate(over="ignore"):
        pair = joined(w1, t.hash)
        keys = np.stack([pair, joined(w2, t.hash ^ _U(0x5851F42D4C957F2D)), joined(joined(w2, w1), pair)])
    return keys >> _U(64 - wide)


def mixed(t: Tokens, word: np.ndarray, n: np.ndarray, texts: float, p: np.ndarray) -> np.ndarray:
    """Probability of each token from the counts of words and :func:`grams`, the number of training texts and the class model's p.

    A context's count is that of its word or pair. Two places on, a text's last word is followed by nothing: that too is
    an outcome, which no token has, so the probabilities of tokens add up to 1 at most.
    """
    pair, skip, triple = n
    near, far, two = (np.full(len(p), texts) for _ in range(3))
    inner, deep = t.place >= 1, t.place >= 2
    near[1:][inner[1:]] = word[:-1][inner[1:]]
    far[2:][deep[2:]] = word[:-2][deep[2:]]
    two[1:][inner[1:]] = pair[:-1][inner[1:]]
    a, b = NARROW
    p = ((pair + a * p) / (near + a) + (skip + a * p) / (far + a)) / 2
    return (triple + b * p) / (two + b)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte of equal place, compressed; sorted keys go in as differences."""
    return pa.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows with the number of their chunk and their place in it."""
    chunk, size, row = TaskContext.get().partitionId() << 32, 0, 0
    for b in batches:
        numbers, places = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for i, t in enumerate(b.column("_text")):
            n = len(utf8(t.as_py())) + 1
            if size and size + n > CHUNK:
                chunk, size, row = chunk + 1, 0, 0
            size += n
            numbers[i], places[i] = chunk, row
            row += 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers), pa.array(places)], [*b.schema.names, "chunk", "place"])


def _runs(batches: Iterator[pa.RecordBatch], column: str):
    """(value, batch slices) for each run of rows with equal values in ``column``."""
    at, held = None, []
    for b in batches:
        x = b.column(column).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        for s, e in zip(cut, cut[1:]):
            if e > s:
                if held and x[s] != at:
                    yield at, held
                    held = []
                at = x[s]
                held.append(b.slice(s, e - s))
    if held:
        yield at, held


def _own(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some texts and their counts among the tokens that train."""
    all_keys = np.sort(keys, axis=None)
    cut = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
    u, n = all_keys[cut], np.diff(cut, append=len(all_keys))
    if not trains.all():
        held, m = np.unique(keys[:, ~trains], return_counts=True)
        n[np.searchsorted(u, held)] -= m
    return u, n


def _trains(parts: list[pa.RecordBatch]) -> np.ndarray:
    return np.array([h is False for b in parts for h in b.column("_held").to_pylist()], bool)


def _cut(u: np.ndarray, bits: int, wide: int) -> list[slice]:
    """Distinct sorted keys of ``wide`` bits by their first ``bits`` bits."""
    edge = [*np.searchsorted(u, np.arange(1 << bits, dtype=_U) << _U(wide - bits)).tolist(), len(u)]
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def _pieces(parts: list[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of a chunk as they were read together: runs of places that follow one another."""
    held, at = [], None
    for b in parts:
        x = b.column("place").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(x) != 1) + 1).tolist(), len(x)]
        for s, e in zip(cut, cut[1:]):
            if held and x[s] != at + 1:
                yield held
                held = []
            held.append(b.slice(s, e - s))
            at = x[e - 1]
    yield held


def _sent(bits: int, wide: int):
    """Task: the keys of each chunk with its own counts; words in shards 0 to 2**bits - 1, grams in those after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, held in _runs(batches, "chunk"):
            for parts in _pieces(held):
                trains, rows = _trains(parts), []
                each = [(words(t)[None], grams(t, wide), np.bincount(t.doc)) for t in _read(parts)]
                of = np.repeat(trains, np.concatenate([size for *_, size in each]))
                for kind in (0, 1):
                    u, n = _own(np.concatenate([x[kind] for x in each], 1), of)
                    for i, c in enumerate(_cut(u, bits, (64, wide)[kind])):
                        if c.stop > c.start:
                            rows.append((i + (kind << bits), c.stop - c.start, _packed(np.diff(u[c], prepend=_U(0))), _packed(n[c])))
                shard, size, ks, ns = zip(*rows)
                k, first = len(rows), parts[0].column("place")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array([int(chunk)] * k, pa.int64()), pa.array([first] * k, pa.int64()), pa.array(size, pa.int32()), pa.array(ks, pa.binary()), pa.array(ns, pa.binary())],
                    ["shard", "chunk", "place", "size", "keys", "n"],
                )
                del each, of, u, n, rows, ks, ns

    return task(run)


def _answered(bits: int, wide: int):
    """Task: the counts over all chunks of the keys of each shard and chunk, in the order of its keys.

    At its end, the different words of each bucket with a count, as a row without a shard.
    """
    names = ["shard", "chunk", "place", "size", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = np.zeros(BUCKETS + 1, np.int64)
        for shard, parts in _runs(batches, "shard"):
            rows = [r for b in parts for r in zip(*(b.column(c).to_pylist() for c in ("chunk", "place", "size", "keys", "n")))]
            at = np.concatenate([np.cumsum(_numbers(r[3], r[2]), dtype=np.uint64) for r in rows])
            n = np.concatenate([_numbers(r[4], r[2]) for r in rows])
            rows = [r[:3] for r in rows]
            at, order = sorted_places(at, 64 if shard >> bits == 0 else wide)
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums = np.add.reduceat(n[order], cut)
            if shard >> bits == 0:
                types += np.bincount((at[cut][sums > 0] & _U(BUCKET_MASK)).astype(np.int64), minlength=len(types))
            total = np.empty_like(n)
            total[order] = np.repeat(sums, np.diff(cut, append=len(at)))
            s = 0
            for chunk, place, size in rows:
                yield pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int32()), pa.array([chunk], pa.int64()), pa.array([place], pa.int64()), pa.array([size], pa.int32()), pa.array([_packed(total[s : s + size])], pa.binary())], names)
                s += size
            del parts, rows, at, n, order, cut, total
        if types.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([types.tobytes()], pa.binary())], names)

    return task(run)


def _found(keys: np.ndarray, sums: np.ndarray, wide: int) -> np.ndarray:
    """The counts of all keys from those of the distinct ones."""
    x, order = sorted_places(keys.ravel(), wide)
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    if len(cut) != len(sums):
        raise RuntimeError("the keys of a chunk have changed since they were counted")
    out = np.empty(keys.size, np.int64)
    out[order] = np.repeat(sums, np.diff(cut, append=len(x)))
    return out.reshape(keys.shape)


def _scored(key: str, model: Model | None, n: int, v: int, ends: int, gain: np.ndarray, bits: int, wide: int):
    """Task: figures of each text of a chunk, whose rows stand with the counts sent back to it."""

    def pieces(batches: Iterator[pa.RecordBatch]):
        for _, parts in _runs(batches, "chunk"):
            sums: dict[int, list] = {}
            for b in parts:
                for r in zip(*(b.filter(pa.compute.is_valid(b.column("shard"))).column(c).to_pylist() for c in ("place", "shard", "size", "n"))):
                    sums.setdefault(r[0], []).append(r[1:])
            docs = pa.Table.from_batches(parts).filter(pa.compute.field("shard").is_null()).sort_by("place").combine_chunks()
            firsts = sorted(sums)
            edge = [*np.searchsorted(docs["place"].to_numpy(), firsts).tolist(), docs.num_rows]
            for f, s, e in zip(firsts, edge, edge[1:]):
                yield docs.slice(s, e - s).to_batches(), sorted(sums[f], key=lambda r: r[0])

    floor = np.log10(n + v + 1)

    def one(t: Tokens, word: np.ndarray, found: np.ndarray) -> tuple:
        """Tokens, known tokens, base and score of each text."""
        base = np.log10(word + 1.0) - floor
        score = base
        if model is not None:
            classes = model.class_of[t.bucket]
            extra = np.zeros(len(classes))
            ids = features(t, classes)
            for s in range(0, len(classes), BATCH):
                y = classes[s : s + BATCH]
                z = logits(model.weights, model.bias, ids[s : s + BATCH])
                extra[s : s + BATCH] = z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))
            p = 10 ** (base + extra / np.log(10) + gain[classes])
            score = np.minimum(np.log10(mixed(t, word, found, ends, p)), 0)
        return np.bincount(t.doc), np.bincount(t.doc, word > 0).astype(np.int64), np.bincount(t.doc, base), np.bincount(t.doc, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, sums in pieces(batches):
            none, each = np.zeros(0, np.uint64), list(_read(parts))
            keys = (np.concatenate([words(t) for t in each])[None], np.concatenate([grams(t, wide) for t in each], 1))
            word, found = (_found(k, np.concatenate([none, *(_numbers(x, m) for shard, m, x in sums if shard >> bits == kind)]), (64, wide)[kind]) for kind, k in enumerate(keys))
            del sums, keys
            made, at = [], 0
            for t in each:
                own = slice(at, at + len(t.hash))
                at = own.stop
                made.append(one(t, word[0, own], found[:, own]))
            size, known, base, score = (np.concatenate(x) for x in zip(*made))
            columns = [pa.concat_arrays([b.column(c) for b in parts]) for c in (key, "_held")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(size), pa.array(known), pa.array(np.full(len(size), n)), pa.array(base), pa.array(score)],
                [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del parts, each, t, word, found

    return task(run)


def _forget(df: DataFrame) -> None:
    """Lets Spark remove the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def score(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows that are not held out and scores all: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), held_out.alias("_held"))
    kind = dict(docs.dtypes)["_key"]
    docs = stored(docs.mapInArrow(task(_numbered), f"_key {kind}, _text string, _held boolean, chunk long, place long"), "chunks")
    train = docs.where(~F.col("_held")).select("_text", F.pmod(F.xxhash64("_key", "chunk", "place"), F.lit(ROUNDS)).alias("_round"))
    size = docs.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0

    # Counts of words and grams: sent by chunk, added up by shard, sent back.
    bits = max(4, (size // CHUNK).bit_length() - 1)
    wide = min(64, size.bit_length() + PLACES)
    shards = docs.mapInArrow(_sent(bits, wide), "shard int, chunk long, place long, size int, keys binary, n binary").repartition(parts, "shard").sortWithinPartitions("shard")
    answers = stored(shards.mapInArrow(_answered(bits, wide), "shard int, chunk long, place long, size int, n binary"), "answers")
    del shards
    _forget(df)
    types = _added(answers.where("shard IS NULL").select(F.lit(0).alias("block"), F.col("n").alias("table")), "int64").get(0, np.zeros(BUCKETS + 1, np.int64))

    # Classes, and the softmax over them.
    wide_table = np.zeros((BLOCKS, (BUCKETS // BLOCKS + 1) * (NEIGHBOURS + 1)), np.int64)
    for i, x in _added(train.select("_text").mapInArrow(_gathered, "block int, table binary"), "int64").items():
        wide_table[i] = x
    around = wide_table.reshape(-1, NEIGHBOURS + 1)
    per_bucket = around[: BUCKETS + 1, NEIGHBOURS]
    total, ends = int(per_bucket.sum()), int(per_bucket[BUCKETS])
    model, gain = None, np.zeros(CLASSES)
    if total:
        class_of = np.append(cluster(around[:BUCKETS, :NEIGHBOURS], CLASSES - 1), CLASSES - 1)
        n_c, v_c = np.bincount(class_of, per_bucket, CLASSES), np.bincount(class_of, types, CLASSES)
        gain = np.log10(total + types.sum() + 1) - np.log10(n_c + v_c + 1)
        model = Model(class_of, np.zeros((FEATURES, CLASSES), np.float32), np.log((n_c + 1) / (total + CLASSES)).astype(np.float32))
        for i in range(ROUNDS):
            rows = _added(train.where(F.col("_round") == i).select("_text").mapInArrow(_trained(model), "block int, table binary"), "float64")
            if rows:
                model = Model(class_of, np.concatenate([rows[j][:-1] / rows[j][-1] for j in range(BLOCKS)]).reshape(FEATURES, CLASSES).astype(np.float32), model.bias)
    _forget(df)
    rows = docs.unionByName(answers.where("shard IS NOT NULL"), allowMissingColumns=True)
    schema = f"_key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = rows.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_scored("_key", model, total, int(types.sum()), ends, gain, bits, wide), schema)
    return scored.withColumnRenamed("_key", key)
