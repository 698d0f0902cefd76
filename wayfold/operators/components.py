"""Connected components as alternating large-star and small-star rounds.

Each round is two joins-free aggregations over the links: every node sends its
larger neighbours (then its smaller ones) to the least node it knows.  Rounds
grow with the logarithm of the longest chain, not with the chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (a, b) with a > b."""
    if large:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(links: DataFrame, *, checkpoint: Callable[[DataFrame], DataFrame], most_rounds: int = 100) -> DataFrame:
    """node and component (its least node) of every node with a link.

    ``links`` has two columns of one orderable type, in either order; loops and
    rows with a null are left out.  ``checkpoint`` cuts the lineage of a round.
    """
    a, b = links.columns
    now = checkpoint(
        links.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    before = None
    for _ in range(most_rounds):
        now = checkpoint(_star(_star(now, True), False))
        total = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.count_if(F.col("a") <= F.col("b"))).first()
        if before == tuple(total):
            break
        before = tuple(total)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def contracted_components(links: DataFrame, *, checkpoint: Callable[[DataFrame], DataFrame], most_rounds: int = 100) -> DataFrame:
    """As ``connected_components``, for graphs with many links a node.

    Each round every node points to its least neighbour if that is less than
    itself, pointers are followed to their ends, and links between the ends
    make the next round's graph.  Nodes at least halve in two rounds; a dense
    graph's links are read by the first round only, what follows is as small as
    the nodes.
    """
    a, b = links.columns
    now = checkpoint(links.where(f"`{a}` <> `{b}`").select(F.col(a).alias("a"), F.col(b).alias("b")))
    found = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("node"), F.col("b").alias("up")).unionAll(now.select("b", "a"))
        low = both.groupBy("node").agg(F.min("up").alias("up")).select("node", F.least("node", "up").alias("up"))
        ends = _followed(checkpoint(low), checkpoint)
        if found is None:
            found = ends
        else:
            further = ends.select(F.col("node").alias("up"), F.col("up").alias("end"))
            found = checkpoint(found.join(further, "up", "left").select("node", F.coalesce("end", "up").alias("up")))
        first, second = ends.select(F.col("node").alias("a"), F.col("up").alias("x")), ends.select(F.col("node").alias("b"), F.col("up").alias("y"))
        now = checkpoint(now.join(first, "a").join(second, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if now.isEmpty():
            return found.select("node", F.col("up").alias("component"))
    raise RuntimeError("components did not settle")


def _followed(tree: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pointers (node, up) followed to the nodes that point to themselves, in doubling steps."""
    while True:
        further = tree.select(F.col("node").alias("up"), F.col("up").alias("end"))
        moved = checkpoint(tree.join(further, "up").select("node", F.col("end").alias("up"), (F.col("end") != F.col("up")).alias("moved")))
        tree = moved.select("node", "up")
        if moved.where("moved").isEmpty():
            return tree
