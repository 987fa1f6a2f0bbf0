"""Toxicity by a weighted lexicon.

A text is folded first: compatibility forms and accents are resolved, invisible characters dropped, letters that
look like Latin ones and digits used for letters replaced, all else made a blank. Aho-Corasick then finds the
lexicon's entries, whole words and word beginnings, outside exception phrases. The summed weights, the weights
per word and the number of different entries give a score from 0 to 1 by a logistic function.

Lexicon, weights and logistic function are fitted on a bounded sample of labelled rows (``FIT_ROWS``, those with
the smallest hash of their id; of an id with several texts that with the smallest hash). Near copies in it, known by equal
minimum word hashes, count once. An entry has to be significantly more frequent in toxic texts (``MIN_LOG_P``); all such
words and word beginnings of the sample are taken.

Defined results: null and empty texts score as texts without a hit; without any labelled row of both kinds all
texts score 0; rows are answered one by one, so repeated rows get equal scores; ties between entries go by name;
further columns pass through, equal names are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.session import stored
from rivulet.llm.common import mix64, task, utf8, word_hashes

#: Labelled rows that the fit reads at most.
FIT_ROWS = 20_000
#: Natural logarithm of the chance, at the overall share of toxic texts, that an entry must stay under.
MIN_LOG_P = -7.0
#: Least weight of an entry: the logarithm of how much more frequent it is in toxic texts.
MIN_WEIGHT = 1.0
PREFIXES = (4, 5, 6, 7, 8)

# Characters read as Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "ѵ": "v", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ӏ": "l", "ı": "i", "ß": "ss",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
}
#: Phrases in which an entry doesn't count.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "trash compactor", "trash truck", "trash day", "take out the trash",
    "clown fish", "clown shoes", "clown car", "clown college", "circus clown", "class clown", "rodeo clown",
    "idiot proof", "idiot light", "useful idiot", "the idiot by dostoevsky", "village idiot", "sore loser rule", "sore loser law", "loser bracket", "pond scum", "soap scum", "scum line",
    "oxymoron", "stupid simple", "stupid hat", "pathetic fallacy", "worthless check", "worthless stock",
)


class _Fold(dict):
    """Code point to folded string; found when first met."""

    def __missing__(self, c: int) -> str:
        x = "".join(LOOKALIKES.get(y, y) for y in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(y))
        if unicodedata.category(chr(c)) in ("Cf", "Mn", "Me"):
            x = ""
        else:
            x = "".join(y for y in x if y.isalpha()) or " "
        self[c] = x
        return x


_FOLD = _Fold()
#: A letter substitute only counts inside a word: not at its end, where ! and the like are marks.
_MARKS = re.compile(r"[!|$@]+(?=\s|$)")


def fold(text: str | None) -> str:
    """The text as blank-separated folded words, with a blank at either end."""
    if not text:
        return " "
    return f" {' '.join(_MARKS.sub(' ', text).translate(_FOLD).split())} "


def features(words: set[str]) -> set[str]:
    """Whole words (with a blank at the end) and word beginnings."""
    out = {f" {w} " for w in words if 3 <= len(w) <= 40}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


class Lexicon:
    """Entries with weights, and exception phrases, as one automaton."""

    def __init__(self, weights: dict[str, float], coefficients: list[float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.coefficients, self.exceptions = weights, coefficients, exceptions
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for name, w in self.weights.items():
                a.add_word(name, (name, w))
            for phrase in self.exceptions:
                a.add_word(fold(phrase), (fold(phrase), 0.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def measure(self, text: str | None) -> tuple[float, float, float]:
        """Summed weights, weights per word, different entries."""
        folded = fold(text)
        best: dict[int, tuple[str, float]] = {}
        free: list[tuple[int, int]] = []
        if self.weights:
            for end, (name, w) in self.automaton.iter(folded):
                start = end - len(name) + 1
                if w == 0.0:
                    free.append((start, end))
                elif start not in best or best[start][1] < w:
                    best[start] = (name, w)
        if free:
            best = {s: x for s, x in best.items() if not any(a <= s < b for a, b in free)}
        total = sum(w for _, w in best.values())
        n = folded.count(" ") - 1
        return total, total / (max(n, 0) + 20), float(min(len({x for x, _ in best.values()}), 4))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(_design(rows) @ np.array(self.coefficients), -30, 30)))


def _design(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, float).reshape(-1, 3)
    return np.column_stack([np.ones(len(rows)), np.log1p(rows[:, 0]), np.log1p(100 * rows[:, 1]), rows[:, 2]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton's method; the ridge keeps separable cases finite."""
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
        step = np.linalg.solve(x.T @ (x * w[:, None]) + penalty + 1e-9 * np.eye(len(b)), x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def _log_tail(k: Column, n: Column, p: float) -> Column:
    """A bound on the log chance of k or more successes of n, for k / n above p (Chernoff)."""
    q = k / n
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when(q > p, -n * (q * F.log(q / p) + rest)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns a lexicon from ``labels`` (key, label 0 or 1) and the texts of ``docs``."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(rows)
    named = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen.withColumnRenamed(key, "_key")), "_key")
    one = F.min(F.struct(F.xxhash64("_text"), "_text"))
    sample = stored(named.groupBy("_key", F.col("_label").cast("int").alias("_label")).agg(one["_text"].alias("_text")), "toxicity")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [int(mix64(np.unique(h)).min().view(np.int64)) if len(h := word_hashes(utf8(t.as_py()))) else 0 for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(keys, pa.int64())], ["_key", "_group"])

    schema = T.StructType([sample.schema["_key"], T.StructField("_group", T.LongType())])
    firsts = sample.select("_key", "_text").mapInArrow(task(keyed), schema).groupBy("_group").agg(F.min("_key").alias("_key")).select("_key")
    once = sample.join(F.broadcast(firsts), "_key", "left_semi")  # no more than the sample's rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for t, y in zip(b.column("_text").to_pylist(), b.column("_label").to_pylist()):
                n[y] += 1
                seen[y].update(features(set(fold(t).split())))
        names = [x for x in seen[0].keys() | seen[1].keys() if seen[1][x] + seen[0][x] > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *names]), pa.array([n[1], *(seen[1][x] for x in names)], pa.int64()), pa.array([n[0], *(seen[0][x] for x in names)], pa.int64())], ["name", "pos", "neg"]
        )

    counts = once.select("_text", "_label").mapInArrow(task(counted), "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = stored(counts.where("pos >= 3 OR name = ''"), "lexicon")
    total = counts.where("name = ''").first()
    if not total or not total["pos"] or not total["neg"]:
        return Lexicon({}, [], exceptions)
    pos, neg = total["pos"], total["neg"]
    odds = F.log((F.col("pos") + 0.1) / pos) - F.log((F.col("neg") + 0.1) / neg)
    chance = _log_tail(F.col("pos"), F.col("pos") + F.col("neg"), pos / (pos + neg))
    found = counts.where("name <> ''").withColumn("w", odds).where((F.col("w") > MIN_WEIGHT) & (chance < MIN_LOG_P)).collect()  # words of FIT_ROWS texts
    if not found:
        return Lexicon({}, [], exceptions)
    out = Lexicon({r["name"]: float(min(r["w"], 8.0)) for r in sorted(found, key=lambda r: r["name"])}, [0.0] * 4, exceptions)
    measured = _measured(once, out, "_text").select("_label", "_measure").collect()  # FIT_ROWS rows at most
    x = _design(np.array([r["_measure"] for r in measured]))
    out.coefficients = _logistic(x, np.array([r["_label"] for r in measured], float))
    return out


def _measured(df: DataFrame, lexicon: Lexicon, text: str, into: str = "_measure") -> DataFrame:
    keep = [f for f in df.schema.fields if f.name != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [list(lexicon.measure(t.as_py())) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [pa.array(rows, pa.list_(pa.float64()))], names=[f.name for f in keep] + [into])

    return df.mapInArrow(task(run), T.StructType([*keep, T.StructField(into, T.ArrayType(T.DoubleType()))]))


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    """Appends the score as ``into``; the text goes no further than asked for by the caller's own columns."""
    keep = [f for f in df.schema.fields if f.name != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([lexicon.measure(t.as_py()) for t in b.column(text)], float).reshape(-1, 3)
            made = pa.array(lexicon.score(rows), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [made], names=[f.name for f in keep] + [into])

    return df.mapInArrow(task(run), T.StructType([*keep, T.StructField(into, T.DoubleType())]))


