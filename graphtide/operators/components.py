"""Connected components of an edge list by hooking to the smallest neighbour label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.session import discard, materialize


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label) for every node of edges (a, b: whole numbers), label being the smallest node reachable.

    Each round takes the smallest label among neighbours (a partial aggregate before its shuffle)
    and then the label of that label, so long chains shrink geometrically. Rounds end when no label
    changes; running out of rounds raises. Both sides of each join are plain tables in the shared
    folder, so a hub's rows can be split by adaptive execution.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    total = _total(labels)
    if total[0] == 0:
        return labels
    for _ in range(most_rounds):
        near = both.hint("merge").join(labels.hint("merge"), both.a == labels.node).select(F.col("b").alias("node"), "label")
        hooked = materialize(labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("via"), F.col("label").alias("top"))
        jumped = materialize(hooked.hint("merge").join(up.hint("merge"), F.col("label") == F.col("via")).select("node", F.col("top").alias("label")), "labels")
        now = _total(jumped)
        discard(labels, hooked)
        labels = jumped
        if now == total:
            discard(both)
            return labels
        total = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _total(labels: DataFrame) -> tuple:
    """Labels only ever fall, so an equal sum means that none changed."""
    r = labels.agg(F.count("*"), F.sum(F.col("label").cast("decimal(38,0)"))).first()
    return r[0], r[1]
