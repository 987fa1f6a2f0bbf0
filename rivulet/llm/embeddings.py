"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into two halves, each with a codebook of its own; the product of both books
is a grid of cells. Every vector lies in one cell and, as a query, visits cells in the order of the summed distances
of its halves to the codewords (the multi-sequence order) until the number of visits that gives the target recall.
Vectors met in a visited cell are verified by their cosine in double precision.

Codebooks and the number of visits are fitted on a bounded sample (``SAMPLE`` vectors with the smallest hash of their id): the
visits are as many as reach ``RECALL`` of the sample's own pairs, or, where it has too few, of pairs made at the
threshold by adding noise, up to all cells. All vectors are indexed and all are queries.

Equal vectors count as one with a multiplicity. A cell's members are cut into blocks and its visitors into chunks, so a
full cell is many small tasks; these return counts and one link per vector and task, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows are equal vectors and link; null ids are kept, and a component without any
other id has a null one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.session import stored
from rivulet.llm.common import join_spread, task
from rivulet.llm.components import components

SAMPLE = 20_000
RECALL = 0.995
#: Members of a cell on average, from which the size of the codebooks follows, up to MOST_WORDS each: a sample can't tell more apart.
PER_CELL, MOST_WORDS = 32, SAMPLE // 5
BLOCK, CHUNK = 1024, 2048
LEAST_VISITS = 4
#: Numbers that a task ranks at once.
RANKED = 2_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)[None]


def _book(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Codewords by k-means; empty ones move to the points farthest from theirs."""
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        d = _distances(x, book)
        at = d.argmin(1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, at, x)
        book[n > 0] = total[n > 0] / n[n > 0, None]
        gone = np.flatnonzero(n == 0)
        if len(gone):
            book[gone] = x[np.argsort(-d.min(1), kind="stable")[: len(gone)]][: len(gone)] if len(x) >= len(gone) else book[gone]
    return book


class Grid:
    def __init__(self, books: tuple[np.ndarray, np.ndarray], visits: int, size: int):
        self.books, self.visits, self.size = books, visits, size

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return _distances(x[:, :cut], self.books[0]), _distances(x[:, cut:], self.books[1])

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each vector in multi-sequence order.

        The cell made of the i-th and j-th nearest codewords has at least (i+1)(j+1)-1 cells before it, so only
        those with (i+1)(j+1) <= visits can be among the first.
        """
        one, two = self.halves(x)
        k = one.shape[1]
        visits = min(visits, k * k)
        a, b = np.argsort(one, 1, kind="stable")[:, :visits], np.argsort(two, 1, kind="stable")[:, :visits]
        i, j = np.divmod(np.arange(a.shape[1] * b.shape[1]), b.shape[1])
        near = (i + 1) * (j + 1) <= visits
        i, j = i[near], j[near]
        total = np.take_along_axis(one, a, 1)[:, i] + np.take_along_axis(two, b, 1)[:, j]
        first = np.argsort(total, 1, kind="stable")[:, :visits]
        return (np.take_along_axis(a, i[first], 1) * k + np.take_along_axis(b, j[first], 1)).astype(np.int32)


def _rank(grid: Grid, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """How many cells each vector visits before the given one."""
    one, two = grid.halves(x)
    a, b = np.divmod(cell, one.shape[1])
    rows = np.arange(len(x))
    far = one[rows, a] + two[rows, b]
    two.sort(1)
    return np.array([int(np.searchsorted(two[r], far[r] - one[r]).sum()) for r in rows])


def fit(sample: np.ndarray, n: int, least: float, seed: int = 7) -> Grid:
    """Codebooks and number of visits from unit vectors, for an index of n vectors."""
    k = int(np.clip(np.ceil(np.sqrt(n / PER_CELL)), 2, MOST_WORDS))
    cut = max(1, sample.shape[1] // 2)
    books = (_book(sample[:, :cut], k, seed), _book(sample[:, cut:], k, seed + 1))
    grid = Grid(books, 1, sample.shape[1])
    x, y, known = [], [], 0
    for at in range(0, len(sample), 1000):
        i, j = np.nonzero(sample[at : at + 1000] @ sample.T >= least)
        ok = i + at < j
        i, j = i[ok] + at, j[ok]
        if len(i) > 2000:
            pick = np.random.default_rng(at).choice(len(i), 2000, replace=False)
            i, j = i[pick], j[pick]
        x.append(sample[i])
        y.append(sample[j])
        known += len(i)
    if known < 200:
        rng = np.random.default_rng(seed)
        base = sample[: min(len(sample), 500)]
        noise = rng.normal(size=base.shape)
        noise -= (noise * base).sum(1, keepdims=True) * base
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        if (size > 1e-9).all():
            x.append(base)
            y.append(least * base + np.sqrt(1 - least**2) * noise / size)
    x, y = np.concatenate(x), np.concatenate(y)
    if len(x):
        if len(x) > 8000:
            pick = np.random.default_rng(seed).choice(len(x), 8000, replace=False)
            x, y = x[pick], y[pick]
        ranks = np.concatenate([np.minimum(_rank(grid, x[s : s + 500], grid.order(y[s : s + 500], 1)[:, 0]), _rank(grid, y[s : s + 500], grid.order(x[s : s + 500], 1)[:, 0])) for s in range(0, len(x), 500)])
        grid.visits = int(min(k * k, max(LEAST_VISITS, np.quantile(ranks, RECALL, method="higher") + 2)))
    return grid


def _valid(v: str):
    x = F.col(v)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _placed(grid: Grid):
    """Task: each vector with its cell and the cells it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of codewords i and j those with (i + 1)(j + 1) <= visits are ranked.
        step = max(1, int(RANKED / (grid.visits * (1 + np.log(grid.visits)))))
        for b in batches:
            for at in range(0, b.num_rows, min(step, 500)):
                part = b.slice(at, min(step, 500))
                cells = grid.order(_unit(_matrix(part.column("vector"), grid.size)), grid.visits)
                visits = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("vector"), pa.array(cells[:, 0]), visits], ["rep", "copies", "vector", "home", "visits"])

    return run


def _met(size: int, least: float):
    """Task: rows of one block and chunk after another; counts (rep, n, null) and links (rep, null, other)."""

    def linked(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        c = (x @ y.T) / (nx[:, None] * ny[None])
        for i, j in np.argwhere(np.abs(c - least) < 1e-9):  # at the threshold by one fixed order of additions
            c[i, j] = float(np.dot(x[i], y[j])) / (float(np.sqrt(np.dot(x[i], x[i]))) * float(np.sqrt(np.dot(y[j], y[j]))))
        return (c >= least) & (dx[:, None] == dy[None])

    def one(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        visitor = rows.column("visitor").to_numpy()
        m, v = rows.filter(pa.array(~visitor)), rows.filter(pa.array(visitor))
        if not m.num_rows or not v.num_rows:
            return None
        get = lambda t: (_matrix(t.column("vector").combine_chunks(), size), np.diff(t.column("vector").combine_chunks().offsets.to_numpy()), t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("home").to_numpy())
        (x, dx, rx, cx, hx), (y, dy, ry, cy, _) = get(v), get(m)
        hit = linked(x, y, dx, dy) & (rx[:, None] != ry[None])
        if not hit.any():
            return None
        # A member that visits the visitor's cell too counts it there; else it is counted here.
        seen = np.array(m.column("visits").to_pylist(), np.int32)
        mutual = np.zeros_like(hit)
        i, j = np.nonzero(hit)
        mutual[i, j] = (seen[j] == hx[i, None]).any(1)
        n_x = hit @ cy
        n_y = (hit & ~mutual).T @ cx
        # Links within the block: labels fall to the least linked one.
        top = np.iinfo(np.int64).max
        lx, ly = rx.copy(), ry.copy()
        while True:
            bx = np.minimum(lx, np.where(hit, ly[None], top).min(1))
            by = np.minimum(ly, np.where(hit, bx[:, None], top).min(0))
            if (bx == lx).all() and (by == ly).all():
                break
            lx, ly = bx, by
        rep, lab, cnt = np.concatenate([rx, ry]), np.concatenate([lx, ly]), np.concatenate([n_x, n_y])
        some = (cnt > 0) | (rep != lab)
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(cnt[some].astype(np.int64)), pa.array(lab[some])], ["rep", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            rows = pa.Table.from_batches(held)
            key = np.stack([rows.column(c).to_numpy() for c in ("cell", "block", "chunk")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            start = 0
            for end in cut:
                made = one(rows.slice(start, end - start))
                if made is not None:
                    yield made
                start = int(end)
            held = rows.slice(start).to_batches()  # BLOCK + CHUNK rows, and what their hashing adds
        if held:
            made = one(pa.Table.from_batches(held))
            if made is not None:
                yield made

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept (key = component_id)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = df.schema[vector].dataType
    number = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{number}>").alias("vector")).withColumn("fine", _valid("vector"))
    # Equal vectors count as one; rows get a number of their own, so ids may be null or repeated.
    rows = rows.withColumn("mark", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.transform("vector", lambda e: F.when(e == 0, 0.0).otherwise(e.cast("double")).cast("string"))), 256)))
    known = rows.where("fine").groupBy("mark").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("vector").alias("vector"))
    reps = stored(known.withColumn("rep", F.xxhash64("mark")), "vectors")  # 64 bits of a digest
    facts = reps.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size"), F.sum("copies").alias("rows")).first()
    same = rows.select("id", "mark")
    if not facts["n"]:
        return same.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sample = reps.orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(SAMPLE).select("vector").toPandas()["vector"]
    x = np.zeros((len(sample), facts["size"]))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    grid = fit(_unit(x), facts["n"], least)
    placed = stored(reps.select("rep", "copies", "vector").mapInArrow(task(_placed(grid)), f"rep long, copies long, vector array<{number}>, home int, visits array<int>"), "placed")
    calls = placed.select("rep", "copies", "vector", "home", F.explode("visits").alias("cell"))
    # A row per cell: how many members and visitors it has.
    load = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    load = load.join(calls.groupBy("cell").agg(F.count("*").alias("visitors")), "cell")
    load = load.select("cell", "members", "visitors", F.ceil(F.col("members") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("visitors") / CHUNK).cast("int").alias("nc"))
    load = stored(load, "load", min(facts["n"], len(grid.books[0]) ** 2))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "block", "chunk", "visitor", "rep", "copies", "vector", "home", "visits"]
    members = join_spread(placed.withColumn("cell", F.col("home")), load.select("cell", "nb", "nc", F.col("members").alias("_rows")), "cell", facts["n"])
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).withColumn("chunk", spread("nc"))
    visitors = join_spread(calls, load.select("cell", "nb", "nc", F.col("visitors").alias("_rows")), "cell", facts["n"] * grid.visits)
    visitors = visitors.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("nc")).cast("int")).withColumn("block", spread("nb"))
    both = members.withColumn("visitor", F.lit(False)).select(columns).unionByName(visitors.withColumn("visitor", F.lit(True)).withColumn("visits", F.lit(None).cast("array<int>")).select(columns))
    dealt = both.repartition(parts, "cell", "block", "chunk").sortWithinPartitions("cell", "block", "chunk")
    found = stored(dealt.mapInArrow(task(_met(grid.size, least)), "rep long, n long, other long"), "met")
    counts = found.groupBy("rep").agg(F.sum("n").alias("links"))
    joined = components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = reps.select("mark", "rep", "copies", "first").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    named = named.select("mark", "copies", "first", "links", "comp")
    least_id = named.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("_rows"))
    named = join_spread(named, least_id, "comp", facts["n"])
    named = named.select("mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("_rows"))
    linked = join_spread(same.where(F.col("mark").isNotNull()), named, "mark", facts["rows"]).select("id", "n_links", "component_id")
    alone = same.where(F.col("mark").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
