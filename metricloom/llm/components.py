"""Connected components of a link table by hooking, pointer jumping and contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (least node reachable) for every node of links ``a, b`` (long). Loops and repeats are allowed.

    Each round hooks every node to its least neighbour. Such pointers close in circles of two only, whose smaller node
    becomes a root; so every tree holds two nodes at least, and a round leaves at most half of the nodes. Pointers jump
    four at a time until all of them end in a root, which takes a number of steps that grows with the logarithm of the
    longest path; then the links are contracted to the roots. The least node of a root's tree is found once, at the end.

    Every step is written to the shared folder and read back, so its size is known from files and no plan grows; small
    tables are then broadcast by the optimizer's own check, and minima combine before the shuffle.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        hooks = stored(_hooks(links), "hooks")
        while not hooks.where("moved").isEmpty():
            hooks = stored(_jumped(hooks), "hooks")
        hooks = hooks.select("node", "to")
        labels = hooks if labels is None else stored(_follow(labels, hooks), "labels")
        a, b = hooks.toDF("a", "x"), hooks.toDF("b", "y")
        both = links.join(a, "a").join(b, "b").where("x <> y")
        links = stored(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if labels is None:
        return links.toDF("node", "component")
    least = labels.groupBy("to").agg(F.min("node").alias("component"))
    return stored(labels.join(least, "to").select("node", "component"), "components")


def _hooks(links: DataFrame) -> DataFrame:
    """``node, to, moved``: every node's least neighbour, the smaller of two that name each other itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), "hooks")
    root = (F.col("next") == F.col("node")) & (F.col("node") < F.col("to"))
    return least.join(least.toDF("to", "next"), "to").select("node", F.when(root, F.col("node")).otherwise(F.col("to")).alias("to"), F.lit(True).alias("moved"))


def _jumped(hooks: DataFrame) -> DataFrame:
    """Pointers moved on four steps; ``moved`` tells which may not have come to a root."""
    at = hooks.select("node", "to")
    for i in range(3):
        at = at.join(hooks.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("to").alias("last"), F.col("next").alias("to"))
    return at.select("node", "to", (F.col("to") != F.col("last")).alias("moved"))


def _follow(labels: DataFrame, hooks: DataFrame) -> DataFrame:
    """Labels moved on to where their present label points."""
    on = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return labels.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
