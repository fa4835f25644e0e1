"""Connected components of an edge table by minimum labels, hooked labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import materialize, salted_join


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), itself included.

    Each round gives every node the least label among its own and its neighbours', hands this least label on to the
    node's old label too (so that a tree's root learns what its leaves have met), then takes the label of its label.
    Labels only fall, and rounds go on until none does; trees merge as wholes, so chains take few rounds as well.
    A node with many edges is a key with partial aggregation on one side and one row on the other, so no group
    is collected. Labels are written out in each round, which bounds the lineage."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = materialize(labels.select("node", F.least("node", "label").alias("label")), "labels")
    changed = True
    while changed:
        at = labels.withColumnsRenamed({"node": "b", "label": "_of"})
        near = both.join(at, "b").groupBy(F.col("a").alias("node")).agg(F.min("_of").alias("_near"))
        met = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("_near", "label")).alias("_low"), F.col("label").alias("_was"))
        met = materialize(met, "met")
        hooks = met.where("_low < _was").groupBy(F.col("_was").alias("node")).agg(F.min("_low").alias("_hook"))
        lower = met.join(hooks, "node", "left").select("node", F.least("_low", F.coalesce("_hook", "_low")).alias("label"), "_was")
        lower = materialize(lower, "lower")
        # Labels that have a lower one themselves, each once: nodes of a large component share theirs.
        jump = lower.select("label").distinct().join(lower.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label").where("_next <> label")
        found = salted_join(lower, jump, "label", "node").select("node", F.least("label", F.coalesce("_next", "label")).alias("label"), "_was")
        found = materialize(found, "labels")
        changed = not found.where("label <> _was").isEmpty()
        labels = found.select("node", "label")
    labels = labels.withColumnRenamed("label", "component")
    if nodes is None:
        return labels
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
