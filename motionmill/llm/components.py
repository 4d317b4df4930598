"""Connected components by alternating large-star and small-star rounds, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from motionmill.llm._shared import cut


def _star(edges: DataFrame) -> DataFrame:
    """Every neighbour of a node, and the node itself, with the least of them: (node, other, least)."""
    least = edges.groupBy("node").agg(F.min("other").alias("least"))
    return edges.join(least.select("node", F.least("node", "least").alias("least")), "node")


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``pairs`` (columns a, b): root is the least node of its component.

    Self-pairs, repeated pairs and either order are allowed; pairs with a null are ignored; an empty table gives an
    empty one. The least neighbour is a partial aggregate, so a hub's links never meet in one group.
    """
    edges = cut(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _star(both).where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        down = _star(large)
        small = (
            down.select(F.col("other").alias("node"), F.col("least").alias("other"))
            .unionByName(down.select("node", F.col("least").alias("other")))
            .where("node <> other")
            .distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    root = edges.groupBy("node").agg(F.min("other").alias("root"))
    return root.unionByName(edges.select(F.col("other").alias("node"), F.col("other").alias("root")).distinct())
