"""Connected components of a link table, by contraction; nothing of it comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches.  Nodes without a link have no row.

    Each round every node takes its smallest neighbour, if that is smaller, as its parent; parents are followed to their
    roots by pointer jumping; then links are moved to the roots, and loops and repeats go.  A node with very many links
    costs no single task: minima are combined before the shuffle, and both sides of every join are stored tables, so
    that its large partitions can be split.  Self-links are allowed; an empty table gives an empty result.
    """
    kind = links.schema["a"].dataType
    edges = checkpoint(links.select(F.col("a"), F.col("b")).filter("a is not null and b is not null"))
    left, found, named = edges.count(), None, 0
    for _ in range(max_rounds):
        nodes = 2 * left  # a bound: each link has two ends
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parents = checkpoint(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), nodes)
        if not left:
            return parents.select("node", F.col("root").cast(kind).alias("component"))
        while True:
            up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = checkpoint(parents.join(up, F.col("root") == F.col("_n"), "left").select("node", F.col("root").alias("_was"), F.coalesce("_r", "root").alias("root")), nodes)
            moved = not jumped.filter("_was <> root").isEmpty()
            parents = jumped.select("node", "root")
            if not moved:
                break
        if found is None:
            found, named = parents.select("node", F.col("root").alias("component")), nodes
        else:
            up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            found = checkpoint(found.join(up, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_r", "component").alias("component")), named)
        a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(a, "a").select("b", "ra").join(b, "b").filter("ra <> rb")
        edges = checkpoint(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), left)
        left = edges.count()
        if not left:
            return found
    raise RuntimeError("components did not settle")
