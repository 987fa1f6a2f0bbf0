"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.session import drop_stored, stored
from rivulet.llm.common import FEW, SHARE, join_spread


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): for every node of a link the smallest node it reaches.

    Each round gives every node the smallest of its label, its neighbours' labels and the label of its label; labels
    only fall, and rounds end when none does. A node with very many links is cut into parts by its neighbours, and
    its label sent to each part; a label that very many nodes bear is looked up by broadcast. Every round is stored
    in the shared folder.

    Defined results: links from a node to itself and links with a null end count for nothing, repeated and reversed
    links once; further columns are left out; an empty table gives an empty one.
    """
    if rows is None:
        rows = links.count()
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links", 2 * rows)
    n = edges.count()
    most = max(FEW, n // SHARE)
    # SHARE rows at most, as each stands for more than ``most`` links: one file, and fit to broadcast.
    hubs = edges.groupBy("v").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    hubs = stored(hubs, "hubs", 0) if n > most else None
    dealt, first = edges, edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    if hubs:
        dealt = edges.join(F.broadcast(hubs), "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    labels = stored(first, "labels", n)
    while True:
        sent = labels.select(F.col("node").alias("v"), "label")
        if hubs:
            sent = sent.join(F.broadcast(hubs), "v", "left").select("v", "label", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near = dealt.join(sent, ["v", "part"] if hubs else "v").groupBy("u").agg(F.min("label").alias("m"))
        next_one = labels.select(F.col("node").alias("label"), F.col("label").alias("next")).join(labels.groupBy("label").agg(F.count("*").alias("_rows")), "label")
        far = join_spread(labels, next_one, "label", n)  # a label is a node with a label of its own
        after = far.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("before"), F.least("label", "m", "next").alias("label"))
        after = stored(after, "labels", n)
        drop_stored(labels)
        labels = after.select("node", "label")
        if not after.where("label <> before").take(1):
            drop_stored(edges)
            if hubs:
                drop_stored(hubs)
            return labels.select("node", F.col("label").alias("component"))
