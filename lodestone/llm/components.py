"""Connected components of an edge table, by hooking roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import Steps, Stored, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node it can reach.

    Labels make trees, and each round merges trees. Every root takes the smallest root that an edge of
    any node of its tree leads to, if that is smaller than itself (a partial aggregation, so
    neither a node nor a tree with very many edges is a single task). Chains of hooks are followed to
    their end by pointer jumping. In two rounds every tree with an edge is merged: a root that none of its edges
    leads down from is hooked to by a neighbour, or that neighbour hooks to a smaller one, which
    it hooks to in turn. So the rounds follow the logarithm of the number of nodes, on long paths too. Edges
    are contracted to the trees they join and dropped inside one tree, so later rounds shuffle
    fewer. The tables of a round are written, which cuts the lineage; nothing is collected but counts.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    left = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while left.df.limit(1).count():
        hooks = _hooked(left)
        new = stored(labels.df.join(hooks.df, F.col("label") == F.col("root"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        to = lambda end: hooks.df.select(F.col("root").alias(end), F.col("to").alias(f"to_{end}"))
        moved = left.df.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        fewer = stored(moved.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        for done in (labels, left, hooks):
            done.drop()
        labels, left = new, fewer
    left.drop()
    return labels.df.select("node", "label")


def _hooked(edges: Stored) -> Stored:
    """(root, to) for the roots that edges (a > b) lead down from: where their chain of hooks ends."""
    hooks = stored(edges.df.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")), "hooks")
    while True:
        on = hooks.df.select(F.col("root").alias("at"), F.col("to").alias("next"))
        new = stored(hooks.df.join(on, F.col("to") == F.col("at"), "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
        moved = new.df.where("moved").limit(1).count()
        hooks.drop()
        hooks = new
        if not moved:
            return hooks


def merged(labels: DataFrame | None, edges: DataFrame, steps: Steps) -> DataFrame | None:
    """``labels`` (node, label) after more edges (a, b); None as long as there are no edges.

    New edges are taken between components, so the work of a round follows its own edges and
    not those of all rounds before.
    """
    if not edges.limit(1).count():
        return labels
    if labels is None:
        return connected_components(edges)
    new = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = steps(labels.unionByName(new.select("node", F.col("node").alias("label"))), "nodes")
    name = lambda x: every.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
    between = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).where("a != b")
    joined = connected_components(between).select(F.col("node").alias("was"), F.col("label").alias("now"))
    return steps(every.join(joined, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")), "labels")
