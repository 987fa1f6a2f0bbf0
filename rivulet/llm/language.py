"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (lengths 1 to 3, words padded with a blank) in
rank order. A document's own list is compared with each profile: the out-of-place distance adds up how far each
n-gram stands from its rank in the profile, or the full length where the profile lacks it. The nearest language
wins; ties go to the first by code point.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any profile every text is
``und``; texts of any length count whole; repeated rows get equal results; equal names among further columns are
replaced. The score is the distance's margin between the nearest and the second language, from 0 to 1; with only
one profile, the share of the greatest distance that is not reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import task

#: Length of a profile and of a document's list.
PROFILE = 400
_BITS = np.uint64(21)
#: Parts in which each language's n-grams are ranked first, so that a frequent language isn't one task.
PARTS = 8


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or to a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers, with their counts; nothing for a text without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[np.uint32(32)], _letters()[points], [np.uint32(32)]])
    blank = x == 32
    x = x[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)  # one blank between words
    if len(x) <= 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (x[:-1] << _BITS) | x[1:]
    three = (two[:-1] << _BITS) | x[2:]
    return np.unique(np.concatenate([x[x != 32], two, three[(three >> _BITS) & np.uint64(0x1FFFFF) != 32]]), return_counts=True)


def _ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in rank order, ties by number."""
    if len(grams) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        most = counts >= least
        grams, counts = grams[most], counts[most]
    return grams[np.lexsort((grams, -counts))][:PROFILE]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """The profile of each language in ``docs``, from all its texts. Counts are added up before any shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each: dict[str, list] = {}
            for t, name in zip(b.column(text), b.column(lang).to_pylist()):
                each.setdefault(name, []).append(_grams(t.as_py() or ""))
            for name, found in each.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    found = docs.select(text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).mapInArrow(task(count), "lang string, gram long, n long")
    total = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "gram"))
    first = total.withColumn("rank", rank).where(F.col("rank") <= PROFILE).drop("rank")
    out: dict[str, list[tuple[int, int]]] = {}
    for r in first.collect():  # PARTS * PROFILE rows a language at most
        out.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    return {name: [g for _, g in sorted(rows)[:PROFILE]] for name, rows in sorted(out.items())}


class Identifier:
    def __init__(self, known: dict[str, list[int]]):
        self.names = sorted(known)
        self.grams = np.unique(np.concatenate([np.array(known[n], np.int64) for n in self.names]).view(np.uint64)) if self.names else np.zeros(0, np.uint64)
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, n in enumerate(self.names):
            g = np.array(known[n], np.int64).view(np.uint64)
            self.rank[i, np.searchsorted(self.grams, g)] = np.arange(len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = _grams(text or "")
        if not len(grams) or not self.names:
            return "und", 0.0
        own = _ranked(grams, counts)
        at = np.searchsorted(self.grams, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.grams)
        known[inside] = self.grams[at[inside]] == own[inside]
        rank = self.rank[:, np.where(known, at, len(self.grams))]
        distance = np.where(rank >= 0, np.abs(rank - np.arange(len(own))), PROFILE).sum(1)
        order = np.argsort(distance, kind="stable")
        best = distance[order[0]]
        if len(order) == 1:
            return self.names[order[0]], 1 - best / (PROFILE * len(own))
        second = distance[order[1]]
        return self.names[order[0]], float((second - best) / second) if second else 0.0


def identify(df: DataFrame, known: dict[str, list[int]], text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Appends the language and its score."""
    model = Identifier(known)
    keep = [f for f in df.schema.fields if f.name not in into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [model.predict(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays(
                [b.column(f.name) for f in keep] + [pa.array([m[0] for m in made], pa.string()), pa.array([float(m[1]) for m in made], pa.float64())], names=[f.name for f in keep] + list(into)
            )

    return df.mapInArrow(task(run), T.StructType([*keep, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]))
