"""What the operators share: reading tables, hold-out rules and byte-level tokenising."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.session import ship

#: The whitespace of every contract that speaks of words: space and the bytes 9 to 13.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def remainder(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null"))) % mod


def set_apart(df: DataFrame, *replaced: str) -> tuple[DataFrame, dict[str, str], list[tuple[str, str]]]:
    """``df`` under plain names (c0, c1, ...) that no name of an operator's own meets.

    With it, the plain name of each column and those to give back at the end, without the ones that are replaced.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    back = [(c, name) for c, name in zip(plain, df.columns) if name not in replaced]
    return df.toDF(*plain), dict(zip(df.columns, plain)), back


#: Rows of one key that a join leaves to one task: this many, or this share of all rows where that is more.
FEW, SHARE = 1_000, 50_000


def join_spread(df: DataFrame, other: DataFrame, on: str | list[str], n: int) -> DataFrame:
    """Joins to ``other``, which has one row per key and in ``_rows`` the number of rows of ``df`` with it.

    Rows of hot keys stay where they are and meet a broadcast table: of ``n`` rows in all, that holds at most
    ``SHARE`` keys. All other keys are joined by a shuffle.
    """
    often = F.broadcast(other.where(F.col("_rows") > max(FEW, n // SHARE)))
    keys = [on] if isinstance(on, str) else on
    rare = df.join(often.select(*keys), keys, "left_anti").join(other.where(F.col("_rows") <= max(FEW, n // SHARE)), keys)
    return rare.unionByName(df.join(often, keys)).drop("_rows")


# --- vectorised word hashing over UTF-8 bytes -------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
_POW_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _POW, _POW_INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _POW_INV = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE_INV)]), dtype=np.uint64)
    return _POW[:n], _POW_INV[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] a rolling hash of data[i:j], up to the factor base**i. Length len(data)+1."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][:-1], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    inverse = _powers(len(prefix))[1]
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * inverse[start])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without whitespace."""
    solid = np.concatenate([[False], ~_IS_SPACE[data], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


#: Bytes of text that are hashed at once: bounds the arrays beside a very long text, never results.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end at white space, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        gap = _SPACE.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per word, A-Z lower-cased first if asked."""
    out = []
    for part in pieces(text):
        data = np.frombuffer(part, np.uint8)
        if lower:
            data = _LOWER[data]
        start, end = word_spans(data)
        if len(start):
            out.append(span_hash(prefix_hash(data), start, end))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ranges(blobs: list[tuple[np.ndarray, ...]], n: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Blobs that begin with a sorted array of 64-bit keys, cut into ``n`` ranges of keys; ranges without a key are left out."""
    borders = np.arange(1, n).astype(np.uint64) * np.uint64((1 << 64) // n)
    cuts = [[0, *np.searchsorted(b[0], borders).tolist(), len(b[0])] for b in blobs]
    for i in range(n):
        part = [tuple(x[c[i] : c[i + 1]] for x in b) for b, c in zip(blobs, cuts) if c[i + 1] > c[i]]
        if part:
            yield part


def sorted_places(keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``wide`` bits in order, with their places: one sort of plain numbers where both fit into 64 bits."""
    bits = max(1, len(keys) - 1).bit_length()
    if wide + bits > 64:
        order = np.argsort(keys)
        return keys[order], order
    both = np.sort((keys << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64))
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_LIBC = ctypes.CDLL(None)
#: Allocations from this size on go back to the system as soon as they are freed.
_APART = 4 << 20


def give_back() -> None:
    """Returns freed memory to the system at a task's end: Python workers outlive tasks and stand beside others."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc only
        _LIBC.malloc_trim(0)


#: What a worker keeps from task to task, by operator: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(keep: str | None = None) -> None:
    """From now on Arrow's buffers come from malloc, and large allocations go back to the system when freed.

    What other operators kept in this worker goes.
    """
    others = [n for n in KEPT if n != keep]
    for name in others:
        KEPT.pop(name)()
    if others:
        gc.collect()  # what refers to itself
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(_LIBC, "mallopt"):  # glibc only
        _LIBC.mallopt(-3, _APART)  # M_MMAP_THRESHOLD
        _LIBC.mallopt(-1, _APART)  # M_TRIM_THRESHOLD
        _LIBC.mallopt(-8, 1)  # M_ARENA_MAX
        _LIBC.malloc_trim(0)


def task(run: Callable[[Iterator], Iterator], keep: str | None = None) -> Callable[[Iterator], Iterator]:
    """A task's function that holds no freed memory while it runs and gives all back at its end, but for what ``keep`` names in KEPT."""

    def kept_lean(batches: Iterator) -> Iterator:
        lean(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return kept_lean


def lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of numbers as one column of lists."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
