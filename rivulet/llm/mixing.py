"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Its factor is target over size: the whole part is taken as certain copies of
every document, the rest by sampling. For the rest, document i with inclusion chance p draws a uniform number u and
is ranked by [u/(1-u)] / [p/(1-p)]; documents are taken in this order until the words taken come nearest to what
is left of the target, so the sample's size is fixed, in words. The numbers come from a hash of id and seed:
reruns agree.

The cut is found without sorting a source: sums of words per slice of the order (``SLICES`` a source) name the
slice in which the cut falls, and only that slice's documents are ordered.

One row per source meets the documents: by broadcast while there are at most ``SHARE`` sources, beyond that with the
rows of hot sources left in place.

Defined results: null texts and sizes count 0; null sources form one source, last in order; null ids draw one number of
their own; equal ids draw equal numbers and are then ordered by size, and rows equal in all that are taken or left
together; further columns pass through whatever their names, ``source_size``, ``target`` and ``copies`` are replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.session import stored
from rivulet.llm.common import SHARE as FEW_SOURCES
from rivulet.llm.common import join_spread, set_apart

# Fixed values of the production mix.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SLICES = 4096


def size_of(text: Column) -> Column:
    """Words of a text: the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the id and the seed: 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, source: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Appends the target of each source to a table of one row per source with its source_size.

    Targets stop at ``most`` times the source's size and the excess is shared again by weight. Sources ordered by
    size over weight reach their stop in that order, so the final level is the first one at which the next source
    stays below its stop.
    """
    n = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weighted = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")))
    capped = weighted.withColumn("_cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    before, here_on, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(here_on)
    levels = capped.withColumn("_level", level).withColumn("_n", F.row_number().over(order))
    final = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_n", "_level"))).over(all_rows)
    first = levels.withColumn("_final", final["_level"])
    return first.select(*sizes.columns, F.least(F.col("_cap"), F.coalesce(F.col("_final"), F.lit(float("inf"))) * F.col("_w")).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: int = 1, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Appends source_size, target (of the source) and copies to a table with sizes, which is read several times.

    What is found first is one row per source: its target and the last place taken. A last pass applies it.
    """
    plain, name, back = set_apart(df, "source_size", "target", "copies")
    source_name = F.when(F.col(name[source]).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(name[source]).cast("string")))
    rows = plain.withColumns({"k": F.col(name[key]), "s": source_name, "n": F.coalesce(F.col(name[size]).cast("long"), F.lit(0))})
    slim = rows.select("k", "s", "n")
    sums = slim.groupBy("s").agg(F.sum("n").alias("source_size"), F.count("*").alias("_rows"))
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets(sums, "s", weights, share, most).withColumn("sure", F.floor(factor)).withColumn("p", factor - F.col("sure"))
    goal = stored(goal.withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size")), "targets")
    sources, total = goal.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()

    def to_source(df: DataFrame, each: DataFrame) -> DataFrame:
        return df.join(F.broadcast(each.drop("_rows")), "s") if sources <= FEW_SOURCES else join_spread(df, each, "s", total)

    ranked = _ranked(to_source(slim, goal), seed).where("q IS NOT NULL")
    slices = ranked.groupBy("s", "slice").agg(F.sum("n").alias("words"), F.max("rest").alias("goal"))
    upto = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = stored(slices.where("before < goal AND before + words >= goal").select("s", "slice", "before"), "cuts", sources)
    # The documents of the slice that holds the cut: one in SLICES of a source.
    near = ranked.join(F.broadcast(cut) if sources <= FEW_SOURCES else cut, ["s", "slice"])
    within = Window.partitionBy("s").orderBy("q", "k", "n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    near = near.withColumn("start", start).where("start + n / 2 <= rest")
    last = near.groupBy("s").agg(F.max(F.struct("q", "k", "n")).alias("last"))
    ends = goal.join(cut.select("s", F.col("slice").alias("cut")), "s", "left").join(last, "s", "left")
    out = _ranked(to_source(rows, ends), seed)
    # Without a cut the goal lies beyond the last slice, by rounding, or nothing is left to sample.
    taken = F.when(F.col("q").isNull() | (F.col("rest") <= 0), F.lit(False)).when(F.col("cut").isNull(), F.lit(True))
    taken = taken.otherwise((F.col("slice") < F.col("cut")) | (F.col("slice") == F.col("cut")) & F.coalesce(F.struct("q", "k", "n") <= F.col("last"), F.lit(False)))
    out = out.withColumn("copies", (F.col("sure") + taken.cast("long")).cast("long"))
    return out.select(*(F.col(c).alias(n) for c, n in back), "source_size", "target", "copies")


def _ranked(df: DataFrame, seed: int) -> DataFrame:
    """Appends the ranking number q (null where nothing is sampled) and its slice; slices follow the order."""
    df = df.withColumn("u", draw(F.col("k"), seed))
    df = df.withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    return df.withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * SLICES))
