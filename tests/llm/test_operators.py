"""Each operator against brute force on small tables with nulls, empty and very long texts, ties, repeats and clashing names."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import bpe, embeddings, jaccard, language, licenses, maxent, mixing, op01, op07, quality, repeats, toxicity
from rivulet.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(n, seed, alphabet="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = words_of(300, 1), words_of(60, 2)
    edited = base.split()
    edited[40] = "changed"
    near = " ".join(edited)
    half = " ".join(base.split()[:150]) + " " + words_of(150, 9)
    texts = [
        base, base, near, half, None, "", "   \n ", "one", "one two", "One TWO three", "a b c d", "a b c d", passage + " " + words_of(80, 3), words_of(70, 4) + " " + passage,
        words_of(20, 5) + "\n" + words_of(20, 5), "x" * 5000, "ab" * 400, "aé" * 200, words_of(20000, 6), "!!! ??? 123", "Ünïcödé Straße ΣΑΣ 中文 🙂", passage, near, "z" * 100, "z" * 99,
    ]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id at all", "en", "s1", 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- BPE -----------------------------------------------------------------------------------------


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op01.tokenizer_path())


def test_bpe_equals_the_library(docs, none, rows):
    path, t = op01.tokenizer_path(), library()
    clash = docs.withColumn("ids", F.lit("clash"))
    got = bpe.encode(clash, path)
    assert [c for c in got.columns if c != "ids"] == docs.columns
    pairs = got.select("text", "ids").collect()
    assert len(pairs) == len(rows)
    for text, ids in pairs:
        assert ids == t.encode(text or "", add_special_tokens=False).ids
    for text, ids, back in bpe.decode(got.withColumnRenamed("text", "was"), path).select("was", "ids", "text").collect():
        assert back == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, path).count() == 0


def test_bpe_random_texts():
    c, t, r = bpe.codec(op01.tokenizer_path()), library(), random.Random(5)
    alphabet = "aehinorstl" * 3 + "éèß'’ \n\t0123.,!_#ÀΣςİ²Ⅷ中🙂́\x1c\x85"
    for text in ["".join(r.choices(alphabet, k=r.randint(0, 120))) for _ in range(800)] + ["a" * 3000, "<|endoftext|>Hi<|startoftext|> x", "it's they'RE"]:
        assert c.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


# --- Language ------------------------------------------------------------------------------------


def test_language_brute_force(docs, none, rows):
    def grams(text):
        x = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
        x = re.sub(" +", " ", x)
        n = Counter()
        if x.strip():
            for size in (1, 2, 3):
                for i in range(len(x) - size + 1):
                    g = x[i : i + size]
                    if g.strip() and not (size == 1 and g == " ") and not (size == 3 and g[1] == " "):
                        n[g] += 1
        return n

    number = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    rank = lambda n: [number(g) for g, _ in sorted(n.items(), key=lambda x: (-x[1], number(x[0])))[: language.PROFILE]]
    total = {}
    for _, t, lang, *_ in rows:
        if lang and t is not None:
            total.setdefault(lang, Counter()).update(grams(t))
    known = language.profiles(docs)
    assert {k: [x % (1 << 64) for x in v] for k, v in known.items()} == {k: rank(v) for k, v in total.items()}
    out = {r["text"]: (r["lang_pred"], r["score"]) for r in language.identify(docs.withColumn("score", F.lit(9)), known).collect()}
    for text, (lang, score) in out.items():
        own = rank(grams(text or ""))
        if not own:
            assert (lang, score) == ("und", 0.0)
            continue
        far = {k: sum(abs(v.index(g) - i) if g in v else language.PROFILE for i, g in enumerate(own)) for k, v in ((k, rank(v)) for k, v in total.items())}
        assert lang == min(sorted(far), key=far.get) and 0 <= score <= 1
    assert language.profiles(none) == {} and language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0


# --- Repeats -------------------------------------------------------------------------------------


def test_repeats_brute_force(docs, none, rows):
    got = {}
    for r in repeats.repeats(docs.withColumn("spans", F.lit(1)).withColumn("start", F.lit("x"))).collect():
        got.setdefault((r["doc_id"], r["text"]), []).append([(s["start"], s["stop"]) for s in r["spans"]])
    seen, expected = set(), {}
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        expected[i, t] = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(cover))]
    assert got.keys() == expected.keys()
    for k, spans in got.items():
        assert all(s == expected[k] for s in spans), k
    assert len(got[rows[3][0], rows[3][1]]) == 2
    assert repeats.repeats(none).count() == 0
    clash = ["ord", "d1", "first", "marks", "_doc", "c0"]
    out = repeats.repeats(docs.withColumns({c: F.lit(c) for c in clash}))
    assert out.columns == [*docs.columns, *clash, "spans"]
    assert {tuple(r[c] for c in clash) for r in out.collect()} == {tuple(clash)}


def test_repeats_of_hot_anchors(spark, docs, rows, monkeypatch):
    """Every anchor split, and only that of a common line: the same spans as without."""
    line, tail = "the same words stand in each of these texts, in a line of its own", words_of(40, 31)
    more = [(100 + i, f"{words_of(30, 40 + i)}\n{line}\n{tail if i % 3 == 0 else words_of(30, 80 + i)}", "en", "s1", 1) for i in range(40)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(5)
    spans = lambda: Counter((r["doc_id"], r["text"], str(r["spans"])) for r in repeats.repeats(df).collect())
    monkeypatch.setattr(repeats, "HOT", 10**9)
    assert not len(repeats.hot_anchors(df, "text", 100))
    plain = spans()
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "HOT_SHARES", 10**7)
    every = repeats.hot_anchors(df, "text", 100)
    assert len(every) == len(set(np.concatenate([repeats.anchors(np.frombuffer((t or "").encode(), np.uint8), 100)[2] for t in [r[1] for r in [*rows, *more]]]).tolist()))
    assert spans() == plain
    monkeypatch.setattr(repeats, "HOT", 30)
    monkeypatch.setattr(repeats, "HOT_SHARES", 200)
    few = repeats.hot_anchors(df, "text", 100)
    assert 1 <= len(few) < 20 and spans() == plain
    of = [set(repeats.anchors(np.frombuffer(t.encode(), np.uint8), 100, few)[2].tolist()) for _, t, *_ in more]
    assert not of[1] & of[2]  # different surroundings of the line meet nowhere


def test_repeats_in_long_periodic_texts(spark):
    """Ten million letters of one kind, shorter and longer periods, and a long text twice: memory and figures stay in bounds."""
    long = words_of(200_000, 21)
    rows = [(1, "x" * 10_000_000), (2, "abc" * 300_000), (3, words_of(12, 22)[:65] * 9_000), (4, long), (5, "y" + long)]
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = [len(t) for _, t in rows]
    assert [got[i] for i in range(1, 6)] == [[(1, n[0])], [(3, n[1])], [(len(words_of(12, 22)[:65]), n[2])], [], [(1, n[4])]]


def test_anchors_are_few_and_cover_all():
    for text in (b"x" * 100_000, b"ab" * 3000, words_of(3000, 4).encode(), b"z" * 100, b"short"):
        data = np.frombuffer(text, np.uint8)
        first, stop, keys, _ = repeats.anchors(data, 100, np.sort(repeats.anchors(data, 100)[2]))
        assert (first[1:] == stop[:-1]).all() and (not len(first) or (first[0], stop[-1]) == (0, len(text) - 99))
        where = {}  # equal strings have equal anchors
        for s, e, k in zip(first.tolist(), stop.tolist(), keys.tolist()):
            for p in range(s, min(e, 5000)):
                assert where.setdefault(text[p : p + 100], k) == k
        first, stop, keys, several = repeats.anchors(data, 100)
        assert (first[1:] == stop[:-1]).all() and (not len(first) or (first[0], stop[-1]) == (0, len(text) - 99))
        if len(set(text)) < 3:
            assert several.all() == (len(text) > 100) and len(set(keys.tolist())) <= 1 and len(first) <= len(text) // repeats.RUN + 2


def test_run_index_matches_brute_force():
    r = random.Random(3)
    strings = ["".join(r.choices("ab", k=r.randint(0, 60))).encode() for _ in range(30)] + [b"abab" * 20, b"", b"a" * 50]
    strings += strings[:5]
    found = repeats.RunIndex(strings)
    text = [*map(list, strings)]
    seen, want = set(), np.zeros(found.n, bool)
    for at, s in zip(found.starts, strings):
        for p in range(len(s) - 11):
            want[at + p] = s[p : p + 12] in seen
            seen.add(s[p : p + 12])
    assert (found.repeated(12) == want).all() and len(found.runs[0]) < found.n and len(text) == len(strings)


# --- Jaccard -------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = []
    for i, t, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets.append({tuple(w)} - {()} if len(w) < size else {tuple(w[j : j + size]) for j in range(len(w) - size + 1)})
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    out = []
    for a in range(len(rows)):
        ids = [rows[b][0] for b in range(len(rows)) if comp[b] == comp[a] and rows[b][0] is not None]
        out.append((rows[a][0], len(sets[a]), min(ids, default=None) if sets[a] else rows[a][0]))
    return Counter(out)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_brute_force(docs, none, rows, size, percent):
    out = jaccard.join(docs.withColumn("n_shingles", F.lit("x")).withColumn("rep", F.lit(0)), size=size, percent=percent)
    assert Counter(tuple(r) for r in out.collect()) == brute_components(rows, size, percent)
    if size == 4:
        assert jaccard.join(none, size=size, percent=percent).count() == 0


def test_jaccard_graded_copies(spark):
    r = random.Random(8)
    base = words_of(120, 11).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((i, " ".join(w[: r.randint(105, 120)]), None, None, None))
    rows += [(100 + i, " ".join(base[:40]) + " " + words_of(40, 100 + i), None, None, None) for i in range(30)]
    out = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(4), size=4, percent=85)
    assert Counter(tuple(x) for x in out.collect()) == brute_components(rows, 4, 85)


def test_parts_guarantee_a_meeting():
    r, bands = np.random.default_rng(1), jaccard.Bands(85)
    for n in (6, 7, 11, 15, 16, 31, 33, 64, 127, 128, 500, 1023, 1025):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            total = 2 * n
            drop = int(r.integers(0, bands.reach(total) + 1))
            b = np.unique(np.concatenate([a[drop // 2 :], r.integers(0, 1 << 63, drop - drop // 2, dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 85 * (len(a) + len(b) - inter) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(jaccard.part_keys(a, bands), jaccard.part_keys(b, bands)))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (12, 11), (7, 7)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 6)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and {got[i] for i in range(100, 141)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs_and_a_large_component(spark):
    links = [(5, 1000 + i) for i in range(3500)] + [(9000, 1000), (9001, 9000), (2, 9001)] + [(20_000 + i, 20_001 + i) for i in range(50)] + [(None, 1), (1, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in [5, 2, 9000, 9001, *range(1000, 4500)]} == {2} and {got[20_000 + i] for i in range(51)} == {20_000} and len(got) == 3504 + 51


# --- Toxicity ------------------------------------------------------------------------------------


def test_toxicity_learns_and_folds(spark, none):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = words_of(60, i, "abcdefghijklmnop")
        rows.append((i, text + (" you zigglefratz and wobblesnark zigglefratz" if bad else ""), "en", "s", None))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marks)
    assert " zigglefratz " in lexicon.weights
    tests = [(1, "z1gglefr4tz and wo66 w0bblesnark you", None, None, None), (2, "zіgglefratz wоbblesnаrk", None, None, None), (3, "quiet words only", None, None, None), (4, None, None, None, None), (5, "", None, None, None), (6, words_of(20000, 3), None, None, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(tests, SCHEMA).withColumn("score", F.lit("x")), lexicon).collect()}
    assert got[1] >= 0.7 and got[2] >= 0.7 and all(got[i] < 0.5 for i in (3, 4, 5, 6))
    free = toxicity.Lexicon({" trash ": 5.0}, [0.0] * 4)
    assert free.measure("a trash can")[0] == 0 and free.measure("what trash")[0] == 5.0
    empty = toxicity.fit(none, marks)
    assert [r["score"] for r in toxicity.score(docs.limit(3), empty).collect()] == [0.0] * 3


def test_toxicity_scores_by_brute_force(rows):
    """Places, weights, phrases and the logistic function, counted word by word."""
    weights = {" trash ": 5.0, " tras": 2.0, " abcd": 1.5, " abc ": 3.0, " one ": 0.5, " idiot ": 4.0}
    lexicon = toxicity.Lexicon(weights, [-4.0, 1.2, 0.8, 0.3])
    texts = [t for _, t, *_ in rows] + ["Trash, trashy tr4sh trash can!", "an idiot proof idiot", "abcdef abc ABC one", "trash " * 3000]
    got = lexicon.score(np.array([lexicon.measure(t) for t in texts]))
    for t, score in zip(texts, got):
        words = toxicity.fold(t).split()
        free = {i + k for p in toxicity.EXCEPTIONS for n in [len(toxicity.fold(p).split())] for i in range(len(words)) if words[i : i + n] == toxicity.fold(p).split() for k in range(n)}
        total, kinds = 0.0, set()
        for i, w in enumerate(words):
            best = max(((x, name) for name, x in weights.items() if (f" {w} ").startswith(name)), default=None)
            if best and i not in free:
                total += best[0]
                kinds.add(best[1])
        z = -4.0 + 1.2 * np.log1p(total) + 0.8 * np.log1p(100 * total / (len(words) + 20)) + 0.3 * min(len(kinds), 4)
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_toxicity_on_held_out_rows(spark, sf):
    out = op07.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic").agg(F.sum("predicted").alias("hit"), F.count("*").alias("n")).collect()
    by = {r["toxic"]: (r["hit"], r["n"]) for r in out}
    assert by[1][0] >= 0.75 * by[1][1] and by[0][0] <= 0.01 * by[0][1]


# --- Licences ------------------------------------------------------------------------------------


def test_licenses(spark, none):
    mit = licenses.MIT
    texts = [mit, mit.upper().replace("\n", "\r\n").replace(",", " ; "), mit.replace("license", "licence").replace("<year> <copyright holders>", "1999 Jo"), mit + " and more", None, "", "   ", "x " * 20000]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).withColumn("license", F.lit(1))
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["license"] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert got[4]["canonical_sha256"] is None and got[5]["canonical_sha256"] == hashlib.sha256(b"").hexdigest()
    for i, t in enumerate(texts):
        if t is not None:
            assert got[i]["canonical_sha256"] == hashlib.sha256(licenses.canonical_text(t).encode()).hexdigest()
    assert licenses.scan(none).count() == 0


BSD_2 = """Copyright (c) 2020, Jo
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
COMMON = "/usr/share/common-licenses"


def test_whole_texts_of_common_licenses(spark):
    whole = [(BSD_2, "BSD-2-Clause"), ("This work is licensed under the GNU General Public License, version 3.", None)]
    for name, license in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{COMMON}/{name}"):
            whole.append((open(f"{COMMON}/{name}", encoding="utf-8").read(), license))
    got = licenses.scan(spark.createDataFrame([(i, t, None, None, None) for i, (t, _) in enumerate(whole)], SCHEMA)).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: n for i, (_, n) in enumerate(whole)}
    assert {"BSD-3-Clause", "Unlicense", "GPL-1.0", "LGPL-2.0", "MPL-1.1"} <= set(licenses.digests().values())


# --- Mixing --------------------------------------------------------------------------------------


def fill(sizes, weights, share=1.5, most=2.0):
    total, left, out = share * sum(sizes), set(range(len(sizes))), {}
    while left:
        level = (total - sum(out.values())) / sum(weights[i] for i in left)
        over = [i for i in left if level * weights[i] > most * sizes[i]]
        if not over:
            return [out.get(i, level * weights[i]) for i in range(len(sizes))]
        for i in over:
            out[i] = most * sizes[i]
            left.discard(i)
    return [out[i] for i in range(len(sizes))]


def test_targets(spark):
    r = random.Random(4)
    for n in (1, 2, 3, 7, 20):
        sizes = [r.choice([0, 10, 1000, r.randint(1, 10**6)]) for _ in range(n)]
        got = mixing.targets(spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long"), "source")
        got = [x["target"] for x in sorted(got.collect(), key=lambda x: x["source"])]
        assert got == pytest.approx(fill(sizes, [(3, 1, 2)[i % 3] for i in range(n)]), abs=1e-6)


def test_mixing(spark, docs, none):
    rows = [(i, words_of(random.Random(i).randint(1, 60), i), None, ["a", "b", "c", None][min(i % 7, 3)], None) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", mixing.size_of(F.col("text"))).withColumn("target", F.lit("x"))
    out = mixing.mix(df).collect()
    assert len(out) == 2000 and all(0 <= r["copies"] <= 2 for r in out)
    for source in ("a", "b", "c", None):
        mine = [r for r in out if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 60
    assert {(r["doc_id"], r["copies"]) for r in out} == {(r["doc_id"], r["copies"]) for r in mixing.mix(df.repartition(7)).collect()}
    odd = docs.withColumn("size", mixing.size_of(F.col("text")))
    clash = ["k", "s", "n", "p", "q", "_p", "_source", "_k", "slice", "rest", "c0", "_rows"]
    more = mixing.mix(odd.withColumns({c: F.lit(c) for c in clash})).collect()
    assert len(more) == docs.count() and {tuple(r[c] for c in clash) for r in more} == {tuple(clash)}
    assert Counter((r["doc_id"], r["copies"]) for r in more) == Counter((r["doc_id"], r["copies"]) for r in mixing.mix(odd).collect())
    assert mixing.mix(none.withColumn("size", F.lit(0).cast("long"))).count() == 0


# --- Embeddings ----------------------------------------------------------------------------------


def test_embeddings_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + r.normal(size=(30, 16)) * 0.05, base[:10], r.normal(size=(300, 16)), np.repeat(base[:1], 5, 0) * 3])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    n = len(rows)
    bad = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [1.0] * 15 + [None]), (n + 4, [1.0] * 15 + [float("nan")]), (n + 5, [1.0] * 15 + [float("inf")]), (n + 6, rows[0][1][:8]), (None, rows[1][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("kept", F.lit("x"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    v = x.astype(np.float32).astype(float)
    v = np.concatenate([v, v[1:2]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    hit = v @ v.T >= 0.95
    np.fill_diagonal(hit, False)
    comp = np.arange(len(v))
    for _ in range(len(v)):
        new = np.minimum(comp, np.where(hit, comp[None], len(v)).min(1))
        if (new == comp).all():
            break
        comp = new
    wrong = 0
    for i in range(n):
        wrong += got[i]["n_links"] != hit[i].sum()
        assert got[i]["kept"] == (got[i]["component_id"] == i) and got[i]["n_links"] <= hit[i].sum()
    found = sum(got[i]["n_links"] for i in range(n))
    assert found >= 0.99 * hit[:n].sum() > 0 and wrong <= 0.05 * n
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(n, n + 7))
    assert got[None]["component_id"] == comp[1] and not got[None]["kept"]
    double = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert Counter(tuple(r) for r in embeddings.near_duplicates(double).collect()) == Counter(tuple(r) for r in embeddings.near_duplicates(df).collect())
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0


def test_embeddings_recall_on_many_clusters(spark):
    """Clusters of graded closeness: 0.99 of all links are found, and none is made up."""
    r = np.random.default_rng(5)
    base = r.normal(size=(400, 32))
    x = np.concatenate([base] + [base + r.normal(size=base.shape) * s for s in (0.1, 0.2, 0.25, 0.3)])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    v = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (v @ v.T >= 0.95).sum(1) - 1
    assert hit.sum() > 1000 and sum(got.values()) >= 0.99 * hit.sum() and all(got[i] <= hit[i] for i in range(len(x)))


def test_visits_grow_until_the_recall_is_reached():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 8))
    grid = embeddings.fit(embeddings._unit(x), 3_000_000, 0.5)
    assert grid.visits > 512 and embeddings._rank(grid, x[:50], grid.order(x[:50], 7)[:, 6]).min() >= 6 and embeddings._rank(grid, x[:50], grid.order(x[:50], 7)[:, 6]).max() <= 7


# --- Language model ------------------------------------------------------------------------------


def test_language_model(docs, none, rows):
    held = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    out = maxent.score(docs.withColumn("score", F.lit("x")), held).collect()
    assert len(out) == len(rows)
    counts, tokens = Counter(), {}
    for i, t, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")] + ["\n"]
        tokens[i] = w
        if not (i is not None and i % 4 == 1):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for r in out:
        w = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert np.isfinite(r["score"]) and r["score"] <= 0
    assert maxent.score(none, held).count() == 0
    all_held = maxent.score(docs, F.lit(True)).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["train_tokens"] == 0 for r in all_held)


def test_class_probabilities_add_up():
    r = np.random.default_rng(0)
    t = maxent.tokens([b"some words in a row", b"", b"more words"])
    assert t.place.tolist() == [0, 1, 2, 3, 4, 5, 0, 0, 1, 2]
    classes = r.integers(0, maxent.CLASSES, maxent.BUCKETS + 1)[t.bucket]
    p = maxent.log_softmax(r.normal(size=(maxent.FEATURES, maxent.CLASSES)), r.normal(size=maxent.CLASSES), maxent.features(t, classes))
    assert np.exp(p).sum(1) == pytest.approx(np.ones(len(classes)))


def test_language_model_knows_word_pairs(spark):
    """Words of one bucket, so that only which word follows which tells the two held-out texts apart."""
    a, b, c, d = (f"{x * 3}word" for x in "abcd")
    rows = [(i, " ".join([a, b, c, d] if i % 2 else [c, d, a, b]), None, None, None) for i in range(40)] + [(100, f"{a} {b} {c} {d}", None, None, None), (101, f"{a} {c} {b} {d}", None, None, None)]
    got = {r["doc_id"]: r for r in maxent.score(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("doc_id") >= 100).collect()}
    assert got[100]["base_score"] == pytest.approx(got[101]["base_score"]) and got[100]["score"] > got[101]["score"] + 1


def test_counted_grams_add_up(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    t = maxent.tokens(texts)
    keys = maxent.grams(t)
    u, n = np.unique(keys, return_counts=True)
    seen, times = np.unique(t.hash, return_counts=True)
    p = np.full(len(t.hash), 1 / len(seen))
    got = maxent.mixed(t, times[np.searchsorted(seen, t.hash)], np.stack([n[np.searchsorted(u, x)] for x in keys]), len(texts), p)
    # The same from counted words.
    word = [[x.lower() if x.isascii() else x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t.decode())] + [None] for t in texts]
    one, two, skip, three = (Counter() for _ in range(4))
    for w in word:
        x = ["<2", "<1", *w]
        one.update(x)
        two.update(zip(x[1:], w))
        skip.update(zip(x, w))
        three.update(zip(x, x[1:], w))
    want = []
    for w in word:
        x = ["<2", "<1", *w]
        for i, y in enumerate(w):
            far = len(word) if i < 2 else one[x[i]]
            q = ((two[x[i + 1], y] + 30 * p[0]) / (one[x[i + 1]] + 30) + (skip[x[i], y] + 30 * p[0]) / (far + 30)) / 2
            want.append((three[x[i], x[i + 1], y] + 8 * q) / ((len(word) if not i else two[x[i], x[i + 1]]) + 8))
    assert got == pytest.approx(np.array(want), rel=1e-9)
    assert maxent.NARROW == (30.0, 8.0)
    for w2, w1 in ((t.hash[6], t.hash[7]), (t.hash[0], t.hash[1])):
        each = [maxent.Tokens(np.array([w2, w1, w], np.uint64), np.zeros(3, np.int32), np.arange(3), np.zeros(3, int)) for w in seen]
        counted = lambda k, u, n: np.where(u[np.minimum(np.searchsorted(u, k), len(u) - 1)] == k, n[np.minimum(np.searchsorted(u, k), len(u) - 1)], 0)
        q = sum(maxent.mixed(x, counted(x.hash, seen, times), np.stack([counted(k, u, n) for k in maxent.grams(x)]), len(texts), p[:3])[2] for x in each)
        assert 0.9 < q <= 1 + 1e-9


# --- Quality -------------------------------------------------------------------------------------


def test_quality_figures(docs, none, rows):
    clash = ["_both", "both", "_word_length", "_gl", "_wl", "c0", "_n"]
    more = docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("x")).withColumns({c: F.lit(c) for c in clash})
    judged = quality.judge(quality.figures(more)).collect()
    assert {tuple(r[c] for c in clash) for r in judged} == {tuple(clash)} and {r["kept"] for r in judged} <= {True, False}
    got = {r["text"]: r for r in quality.figures(more).collect()}
    for _, t, *_ in rows:
        x = t or ""
        w = WORD.findall(x)
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [y for y in x.split("\n") if WORD.search(y)]
        r = got[t]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in x), len(lines) - len(set(lines)), len(covered))
    judged = quality.rules(docs).collect()
    assert len(judged) == len(rows) and all(not (r["base_failed"] and r["kept"]) for r in judged)
    assert quality.rules(none).count() == 0


def test_quality_drops_junk_and_keeps_the_rest(spark):
    rows = [(i, words_of(80, i, "abcdefghijklmnop"), "en", "s1" if i % 2 else "s2", None) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in words_of(80, i).split()), "en", "s1", None) for i in range(10)]
    kept = {r["doc_id"] for r in quality.rules(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert kept == set(range(400))
