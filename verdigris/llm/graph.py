"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._shared import drop, store

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the component's smallest node.

    Each round, every root hooks onto the smallest root that a link leads to, and the
    trees that this makes are flattened by pointer jumping, so a chain of n nodes takes
    about log n jumps.  What a round makes is written to the shared folder, and links
    inside one component leave the table, so later rounds are small.
    Nodes without a link are not in the result; an empty table gives an empty one.
    """
    spark = links.sparkSession
    edges, edges_at = store(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, roots_at = store(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.first("node").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        if edges.isEmpty():
            break
        # Hook: each root takes the smallest root that a link leads to.
        hooks = edges.select(F.col("b").alias("node"), F.col("a").alias("lower")).groupBy("node").agg(F.min("lower").alias("lower"))
        parent = roots.select(F.col("root").alias("node")).distinct().join(hooks, "node", "left").select("node", F.coalesce("lower", "node").alias("up"))
        parent, parent_at = _flattened(parent)
        new_roots, new_at = store(roots.join(parent.select(F.col("node").alias("root"), "up"), "root").select("node", F.col("up").alias("root")), "roots")
        lift = lambda side: parent.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))
        lifted = edges.join(lift("a"), "a").join(lift("b"), "b").where("a_up <> b_up")
        new_edges, new_edges_at = store(lifted.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
        for path in (parent_at, roots_at, edges_at):
            drop(spark, path)
        roots, roots_at, edges, edges_at = new_roots, new_at, new_edges, new_edges_at
    else:
        raise RuntimeError(f"links still join components after {MAX_ROUNDS} rounds")
    return roots


def _flattened(parent: DataFrame) -> tuple[DataFrame, str]:
    """(node, up) with `up` the root of the node's tree, as a stored table and its path."""
    spark = parent.sparkSession
    stored, path = store(parent, "parents")
    while True:
        once = _jumped(stored.select("node", "up"))
        new, new_path = store(_jumped(once.select("node", "up")), "parents")
        drop(spark, path)
        stored, path = new, new_path
        if stored.where("moved").isEmpty():
            return stored.select("node", "up"), path


def _jumped(parent: DataFrame) -> DataFrame:
    above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
