"""Connected components of an edge table, by randomised contraction: everything stays in tables, none at the driver.

In each round every node points at the one of its neighbours and itself that comes first in an order by hashes, drawn
anew for the round. Edges are redrawn between what their ends point at, and loops and repeats go. In expectation at
least a quarter of the nodes vanish in a round whatever the graph, chains of ascending ids included, so the rounds
are logarithmic in the nodes. Each round's pointers are stored; in the end they are followed from the last round back
to the first, over tables that grow as the rounds' shrank, and the smallest node of each component names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import stored


def contracted(edges: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(node, to) of a round and the edges that are left."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    drawn = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("id"))
    least = both.groupBy("a").agg(F.min(drawn("b")).alias("m"))
    step = stored(least.select(F.col("a").alias("node"), F.least("m", drawn("a"))["id"].alias("to")), "step")
    ends = [step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
    redrawn = edges.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
    left = redrawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
    return step, stored(left, "edges")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node. Null ends are left out."""
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = stored(given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        step, left = contracted(left, len(steps))
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps.pop()
    while steps:
        ahead = labels.select(F.col("node").alias("to"), F.col("to").alias("further"))
        labels = stored(steps.pop().join(ahead, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "labels")
    names = stored(labels.groupBy("to").agg(F.min("node").alias("component")), "names")
    return stored(labels.join(names, "to").select("node", "component"), "components")
