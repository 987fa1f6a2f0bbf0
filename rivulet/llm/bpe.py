"""BPE encoding and decoding.

Encoding walks each word with the longest token that starts at every place (found by Aho-Corasick), steps
back to the next shorter token where two neighbours could not stand side by side after the merges, and so
reaches the merges' own result in linear time. Two tokens can stand side by side if undoing their merges, the
latest first, never shows a pair across the border that would have been merged earlier. Decoding gathers
token strings through a table of offsets.

Defined results: null and empty texts have no tokens and decode to the empty string; texts of any length are
taken whole; repeated rows are answered row by row; further columns pass through.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rivulet.llm.common import KEPT, task

#: Words, and characters of them, that a worker remembers; beyond that it starts anew. Bounds memory only, never results.
CACHE_WORDS, CACHE_CHARS = 200_000, 8_000_000


class OffsetTable:
    """Strings by number, in one byte array with an offset for each."""

    def __init__(self, parts: list[bytes]):
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.offset[1:])

    def gather(self, numbers: np.ndarray) -> bytes:
        start = self.offset[numbers]
        size = self.offset[numbers + 1] - start
        end = np.cumsum(size)
        if not len(end):
            return b""
        at = np.arange(end[-1]) + np.repeat(start - (end - size), size)
        return self.blob[at].tobytes()


class BpeCodec:
    """Encoder and decoder of a ``tokenizers`` file with a word-end BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.nfc, self.fold = "NFC" in kinds, "Lowercase" in kinds
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = _splitter(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.byte_char = _byte_chars()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._build(merges)
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        names = [b""] * size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            names[i] = name.encode()
        # Without a decoder the library joins token names with blanks.
        self.names = OffsetTable([n + b" " for n in names])
        self.decimals = OffsetTable([b"%d " % i for i in range(size)])
        self.forget()

    # --- tables ---------------------------------------------------------------------------------

    def _symbols(self, name: str) -> str:
        """One character for each symbol: a word's last character with the suffix is a single symbol."""
        if self.suffix and name.endswith(self.suffix) and name != self.suffix:
            body = name[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + 0xE000)
        return name

    def _build(self, merges: list[tuple[str, str]]) -> None:
        symbols = {name: self._symbols(name) for name in self.vocab}
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = self.vocab[a], self.vocab[b]
            whole = self.vocab.get(a + b)
            if whole is None or (left, right) in self.pair:
                continue
            self.pair[left, right] = (rank, whole)
            self.parts.setdefault(whole, (rank, left, right))
        tokens = {s: self.vocab[name] for name, s in symbols.items() if len(s) == 1 or self._reachable(self.vocab[name])}
        self.automaton = ahocorasick.Automaton()
        for s, i in tokens.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        #: Of each token its symbols, and the longest other token that it begins with, or -1.
        self.length = {i: len(s) for s, i in tokens.items()}
        self.shorter = {i: next((tokens[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in tokens), -1) for s, i in tokens.items()}

    def _reachable(self, token: int) -> bool:
        """Whether the merges ever make this token out of its own symbols."""
        if token not in self.parts:
            return False
        rank, left, right = self.parts[token]
        for side in (left, right):
            if side in self.parts and not self._reachable_cached(side):
                return False
        return self._compatible(left, right, rank)

    @lru_cache(maxsize=None)  # noqa: B019  one codec lives as long as its worker
    def _reachable_cached(self, token: int) -> bool:
        return self._reachable(token)

    def _compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether left and right, both complete, can end up side by side. With ``before``: up to that merge."""
        far = 1 << 60
        limit = far if before is None else before
        parts, pair = self.parts, self.pair
        while True:
            met = pair.get((left, right))
            if met is not None and met[0] < limit:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            # The later of the two merges is undone. A pair on the border had to wait for it only if that pair's
            # own merge comes later; at equal rank the left one had been made first.
            if b is None or a is not None and a[0] > b[0]:
                limit, left = min(limit, a[0]), a[2]
            else:
                limit, right = min(limit, b[0] + 1), b[1]

    # --- encoding -------------------------------------------------------------------------------

    def encode_symbols(self, s: str) -> list[int]:
        """Token ids of one word given as symbols."""
        able, shorter, length, longest = self.able, self.shorter, self.length, self.automaton.iter_long
        dead: set[int] = set()  # places that no sequence of tokens reaches the end from
        pos, last, ids = 0, -1, []
        while True:
            for end, (size, token) in longest(s, pos):
                if end - size + 1 != pos:
                    raise ValueError("a symbol is missing from the vocabulary")
                if end + 1 in dead or last >= 0 and not able[last, token]:
                    break
                ids.append(token)
                last = token
                pos = end + 1
            else:
                if pos < len(s):
                    raise ValueError("a symbol is missing from the vocabulary")
                return ids
            # The longest match can't stand here: the next shorter one that can, or else a shorter one before it.
            while True:
                token = shorter[token]
                while token >= 0 and (pos + length[token] in dead or last >= 0 and not able[last, token]):
                    token = shorter[token]
                if token >= 0:
                    break
                dead.add(pos)
                token = ids.pop()
                pos -= length[token]
                last = ids[-1] if ids else -1
            ids.append(token)
            last = token
            pos += length[token]

    def forget(self) -> None:
        self.number: dict[str, int] = _Made(self._learn)
        self.ids: dict[str, list[int]] = _Made(self._encode_word)
        self.able: dict[tuple[int, int], bool] = _Made(lambda pair: self._compatible(*pair))
        self.flat = array("i")
        self.flat_at = array("q", [0])
        self.held = 0

    def _learn(self, chunk: str) -> int:
        """Stores the ids of a chunk of text and returns its number."""
        for word in [chunk] if chunk.isascii() and chunk.isalpha() else self.pieces(chunk):
            self.flat.extend(self.ids[word])
        self.flat_at.append(len(self.flat))
        self.held += len(chunk)
        return len(self.flat_at) - 2

    def _encode_word(self, word: str) -> list[int]:
        chars = word if word.isascii() and word.isprintable() else "".join(map(self.byte_char.__getitem__, word.encode()))
        if self.suffix:
            chars = chars[:-1] + chr(ord(chars[-1]) + 0xE000)
        return self.encode_symbols(chars)

    def _encode_piece(self, text: str) -> np.ndarray:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.fold:  # character by character: no final sigma
            text = text.replace("Σ", "σ").lower()
        # No piece crosses white space, so what stands between is split once and then remembered.
        words = [text] if _SEPARATORS(text) else text.split()
        if self.held > CACHE_CHARS or max(len(self.number), len(self.ids), len(self.able)) > CACHE_WORDS:
            self.forget()
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if not len(which):
            return np.zeros(0, np.int32)
        offset, flat = np.frombuffer(self.flat_at, np.int64), np.frombuffer(self.flat, np.int32)
        start = offset[which]
        size = offset[which + 1] - start
        end = np.cumsum(size)
        return flat[np.arange(end[-1]) + np.repeat(start - (end - size), size)]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.special_at and "<|" in text:
            parts = [np.array([self.special[p]], np.int32) if p in self.special else self._encode_piece(p) for p in self.special_at(text) if p]
            return np.concatenate(parts)
        return self._encode_piece(text)

    # --- decoding -------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        return self.names.gather(ids)[:-1]

    def decimal_text(self, ids: np.ndarray) -> bytes:
        return self.decimals.gather(ids)[:-1]


class _Made(dict):
    """A memory of a function's results."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


#: Separators that str.split() drops and Unicode's white space lacks.
_SEPARATORS = re.compile("[\x1c-\x1f]").search


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    """The splitting pattern, with white space as Unicode defines it."""
    spaces = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return regex.compile(pattern.replace(r"[^\s", f"[^{spaces}")).findall


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    KEPT["bpe"] = codec.cache_clear
    return BpeCodec(path)


def _appended(df: DataFrame, path: str, fields: list[T.StructField], column: str, answer: Callable) -> DataFrame:
    """df with columns computed from one column, batch by batch; new names replace equal old ones."""
    fresh = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in fresh]
    arrow = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(arrow)
        for batch in batches:
            columns = [batch.column(f.name) for f in keep]
            made = answer(batch.column(column))
            yield pa.RecordBatch.from_arrays(columns + [pa.array(m, kinds.field(i).type) for i, m in enumerate(made)], names=[f.name for f in keep] + kinds.names)
        codec(path).forget()

    return df.mapInArrow(task(run, keep="bpe"), T.StructType([*keep, *fields]))


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Appends the token ids of ``text`` as ``into`` (array of int)."""

    def answer(column: pa.Array) -> list:
        c = codec(path)
        return [[c.encode(t.as_py()) for t in column]]

    return _appended(df, path, [T.StructField(into, T.ArrayType(T.IntegerType()))], text, answer)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Appends the text of ``ids`` as ``into``; null ids decode to the empty string."""

    def answer(column: pa.Array) -> list:
        c = codec(path)
        return [[c.decode(np.asarray(t.as_py() or [], np.int64)).decode() for t in column]]

    return _appended(df, path, [T.StructField(into, T.StringType())], ids, answer)


def round_trip(df: DataFrame, path: str, fields: list[T.StructField], digest: Callable[[BpeCodec, np.ndarray, bytes], tuple], text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass over the texts and appends what ``digest(codec, ids, decoded)`` makes of both.

    For callers that need figures of ids and texts but not these themselves: nothing large goes back to the JVM.
    """

    def answer(column: pa.Array) -> list:
        c = codec(path)
        rows = []
        for t in column:
            ids = c.encode(t.as_py())
            rows.append(digest(c, ids, c.decode(ids)))
        return list(zip(*rows)) if rows else [[] for _ in fields]

    return _appended(df, path, fields, text, answer)
