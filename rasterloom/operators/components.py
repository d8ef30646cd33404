"""Connected components by randomised contraction, as joins and grouped minima over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.sources.shared import cut, discard


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); nodes of one component share a root.

    Each round every node joins the neighbour (or itself) that comes first in a fresh hash order and the graph
    is contracted to those representatives, so the expected number of nodes falls by a constant factor whatever
    the diameter. Representatives come from partial aggregates, so a hub is pre-aggregated before the shuffle;
    both join sides are written tables, which lets the planner split a skewed hub or broadcast a small side.
    Nodes are longs: their 64-bit hash is one to one, so a minimum over hashes picks one node and a long is all that
    is aggregated. Self loops, repeated edges and nulls are ignored; no edges give an empty result.
    """
    def tidy(df):
        return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    current = cut(tidy(edges), "edges")
    reps = []
    while not current.isEmpty():
        k = len(reps)
        order = lambda c, k=k: F.xxhash64(F.col(c), F.lit(k))
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        rep = cut(first.select(F.col("a").alias("node"), F.when(order("a") < order("b"), F.col("a")).otherwise(F.col("b")).alias("rep")), "reps")
        reps.append(rep)
        left = rep.select(F.col("node").alias("a"), F.col("rep").alias("ra"))
        right = rep.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        following = cut(tidy(current.join(left, "a").join(right, "b")
                             .select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        discard(current)
        current = following
    discard(current)
    if not reps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    labels = reps[-1].select("node", F.col("rep").alias("root"))
    for rep in reversed(reps[:-1]):
        up = labels.select(F.col("node").alias("rep"), F.col("root"))
        labels = rep.join(up, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    out = cut(labels, "labels")
    discard(*reps)
    return out
