"""Quality rules with adaptive thresholds, in DataFrame functions only.

Figures of each text are computed inside its row. For every language and source, mergeable quantile sketches of the
figures give fences (quartiles widened by a multiple of their distance); small groups take their language's fences,
which come from merging the same sketches. The fences are joined to the documents and decide.

Defined results: null texts count as empty; null languages and sources form groups of their own; texts of any
length count whole; repeated rows get equal results; further columns pass through whatever their names, those that are
appended are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.session import stored
from rivulet.llm.common import set_apart

SYMBOLS = "#*$%&|<>"
#: Documents that a language and source need for fences of their own.
LEAST = 100
#: Widening of the fences, in distances between the quartiles.
REACH = 6.0
#: Places kept by a sketch; its rank error is about 1.5 over that.
SKETCH_K = 2048


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _repeats(words: Column) -> Column:
    """Words in three-word windows found twice or more.

    Windows are sorted with their places; equal neighbours are the repeated ones. Each repeated window then adds
    its words that the one before it hasn't added.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        keys = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p")))
        return F.element_at(F.transform(F.array(F.sort_array(keys)), _covered), 1)

    return F.element_at(F.transform(F.array(words), of), 1)


def _covered(s: Column) -> Column:
    last = F.size(s) - 1
    marked = F.transform(s, lambda x, i: F.when((F.get(s, F.greatest(i - 1, F.lit(0)))["g"] == x["g"]) & (i > 0) | (F.get(s, F.least(i + 1, last))["g"] == x["g"]) & (i < last), x["p"]))
    places = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
    return F.element_at(F.transform(F.array(places), lambda q: F.aggregate(F.transform(q, lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(q, F.greatest(i - 1, F.lit(0)))))), F.lit(0), lambda a, x: a + x)), 1)


def figures(df: DataFrame, text: str = "text") -> DataFrame:
    """Appends n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    plain, name, back = set_apart(df, *FIGURES)
    t = F.coalesce(F.col(name[text]), F.lit(""))
    bare = F.translate(t, " \t\n\x0b\f\r", "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    lines_twice = F.element_at(F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a))), 1)
    both = F.element_at(F.transform(F.array(_words(t)), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("r"))), 1)
    made = {
        "n_words": F.col("both.n"),
        "word_chars": F.length(bare),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": lines_twice,
        "n_repeat_words": F.col("both.r"),
    }
    return plain.withColumn("both", both).select(*(F.col(c).alias(n) for c, n in back), *(made[f].cast("long").alias(f) for f in FIGURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What the fences are put around: name, value, which sides count, and the least width in its own unit.
def _measures() -> dict[str, tuple[Column, bool, bool, float]]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": (F.col("word_chars") / n, True, True, 0.5),
        "symbols": (F.col("n_symbols") / n, False, True, 0.1),
        "dup_lines": (F.col("n_dup_lines") / n, False, True, 0.02),
        "repeats": (F.col("n_repeat_words") / n, False, True, 0.2),
    }


def _sketches(measured: DataFrame, *by: str) -> DataFrame:
    """One KLL sketch per measure and group: partial sketches are merged, so a frequent group isn't one task."""
    names = list(_measures())
    return measured.groupBy(*by).agg(F.count("*").alias("_n"), *(F.expr(f"kll_sketch_agg_double(_{m}, {SKETCH_K})").alias(f"_{m}") for m in names))


def _fenced(sketches: DataFrame, reach: float, prefix: str) -> list[Column]:
    out = []
    for m, (_, low, high, least) in _measures().items():
        q1, q3 = (F.expr(f"kll_sketch_get_quantile_double(_{m}, {q}D)") for q in (0.25, 0.75))
        width = F.greatest((q3 - q1) * reach, F.lit(least))
        if low:
            out.append((q1 - width).alias(f"{prefix}{m}_low"))
        if high:
            out.append((q3 + width).alias(f"{prefix}{m}_high"))
    return out


def judge(df: DataFrame, lang: str = "lang", source: str = "source", least: int = LEAST, reach: float = REACH) -> DataFrame:
    """Appends base_failed and kept to a table with figures, which is read several times."""
    plain, name, back = set_apart(df, "base_failed", "kept")
    names = list(_measures())
    measured = plain.withColumns({f: F.col(name[f]) for f in FIGURES} | {"lang": F.col(name[lang]), "source": F.col(name[source])})
    measured = measured.withColumns({f"_{m}": v for m, (v, *_) in _measures().items()}).withColumn("base_failed", base_failed())
    fine = measured.where(~F.col("base_failed"))
    group = _sketches(fine, "lang", "source")
    wide = group.groupBy("lang").agg(*(F.expr(f"kll_merge_agg_double(_{m}, {SKETCH_K})").alias(f"_{m}") for m in names))
    own = group.where(F.col("_n") >= least).select(F.col("lang").alias("_gl"), F.col("source").alias("_gs"), *_fenced(group, reach, "_own_"))
    common = wide.select(F.col("lang").alias("_wl"), *_fenced(wide, reach, "_all_"))
    joined = measured.join(own, F.col("lang").eqNullSafe(F.col("_gl")) & F.col("source").eqNullSafe(F.col("_gs")), "left").join(common, F.col("lang").eqNullSafe(F.col("_wl")), "left")
    ok = ~F.col("base_failed")
    for m, (_, low, high, _) in _measures().items():
        if low:
            ok = ok & F.coalesce(F.col(f"_{m}") >= F.coalesce(f"_own_{m}_low", f"_all_{m}_low"), F.lit(True))
        if high:
            ok = ok & F.coalesce(F.col(f"_{m}") <= F.coalesce(f"_own_{m}_high", f"_all_{m}_high"), F.lit(True))
    return joined.withColumn("kept", ok).select(*(F.col(c).alias(n) for c, n in back), "base_failed", "kept")


def rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Figures, base_failed and kept of each document. The figures are stored once in the shared folder, without texts."""
    table = figures(df.select(*keep, text, lang, source), text).drop(text)
    return judge(stored(table, "quality"), lang, source)
