"""Types, limits, settings and errors of a changelog table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("k", T.BinaryType()),
    T.StructField("v", T.BinaryType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("is_tombstone", T.BooleanType()),
])

# Fixed values of the data model.
MAX_KEY_BYTES = 65536
MAX_VALUE_BYTES = 2**32
RECORD_OVERHEAD = 17  # key length 4, value length 4 (in the log; the offset in a run), time 8, flag 1
MEMTABLE_OVERHEAD = 13  # offset 4, time 8, flag 1
BLOCK_BYTES = 4096
KEYSPACE = re.compile(r"[A-Za-z0-9_-]{1,255}")
UNITS = {"bytes": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}
DAY_MS = 86_400_000


class ChangelogError(Exception):
    """Base of all errors of this library."""


class KeySizeNone(ChangelogError):
    """A key is null or empty."""


class KeyMaxSizeExceeded(ChangelogError):
    """A key has more than 65536 bytes."""


class ValueSizeNone(ChangelogError):
    """The value of a record that is no delete is null or empty."""


class ValueMaxSizeExceeded(ChangelogError):
    """A value has more than 2**32 bytes."""


class ConflictError(ChangelogError):
    """Another writer has committed the same manifest version."""


class KeyNotFound(ChangelogError):
    """A strict update or delete met a key that is not live."""


@dataclass(frozen=True)
class Config:
    """Settings, fixed when a store is opened."""

    write_buffer_bytes: int = 50 * 1024
    max_buffer_write_number: int = 2
    false_positive_rate: float = 1e-4
    bucket_low: float = 0.5
    bucket_high: float = 1.5
    min_run_bytes: int = 4096
    min_threshold: int = 4
    max_threshold: int = 32
    enable_ttl: bool = False
    entry_ttl_ms: int = 365 * DAY_MS
    tombstone_ttl_ms: int = 120 * DAY_MS
    gc_chunk_bytes: int = 50 * 1024
    allow_prefetch: bool = True
    prefetch_size: int = 10

    def __post_init__(self):
        rules = [
            (self.false_positive_rate > 0, "false_positive_rate must be positive"),
            (self.write_buffer_bytes >= 50 * 1024, "write_buffer_bytes must be 50 KiB at least"),
            (self.max_buffer_write_number > 0, "max_buffer_write_number must be positive"),
            (not self.enable_ttl or self.entry_ttl_ms >= 3 * DAY_MS, "entry_ttl_ms must be 3 days at least"),
            (self.tombstone_ttl_ms >= 10 * DAY_MS, "tombstone_ttl_ms must be 10 days at least"),
            (self.gc_chunk_bytes >= 50 * 1024, "gc_chunk_bytes must be 50 KiB at least"),
            (not self.allow_prefetch or self.prefetch_size > 0, "prefetch_size must be positive"),
            (self.min_threshold >= 2, "min_threshold must be 2 at least"),
        ]
        for ok, said in rules:
            if not ok:
                raise ValueError(said)


def in_bytes(size: float, unit: str) -> int:
    return int(size * UNITS[unit.lower()])


def keyspace_valid(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9_-]+$") & F.octet_length(name).between(1, 255), F.lit(False))


def check_keyspace(name: str) -> str:
    if not KEYSPACE.fullmatch(name):
        raise ValueError(f"not a keyspace name: {name[:40]!r}")
    return name


def size_class(k: Column, v: Column, tombstone: Column | None = None) -> Column:
    """``ok`` or the name of the first rule that key or value breaks; a delete needs no value."""
    live = F.lit(True) if tombstone is None else ~F.coalesce(tombstone, F.lit(False))
    key, value = F.coalesce(F.octet_length(k), F.lit(0)), F.coalesce(F.octet_length(v), F.lit(0))
    return (
        F.when(key == 0, "KeySizeNone")
        .when(key > MAX_KEY_BYTES, "KeyMaxSizeExceeded")
        .when(live & (value == 0), "ValueSizeNone")
        .when(value > F.lit(MAX_VALUE_BYTES), "ValueMaxSizeExceeded")
        .otherwise("ok")
    )


def expired(created_at: Column, ttl_ms: int, as_of: Column) -> Column:
    """Strictly older than the time to live at ``as_of``."""
    return created_at + F.expr(f"INTERVAL '{ttl_ms // 1000}' SECOND") < as_of
