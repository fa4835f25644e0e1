"""Graph operators on edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.operators.closure import component_closure
from traceloom.scratch import materialize


def neighbours(edges: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` edges of each source by target; duplicate edges count."""
    ranked = edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    return ranked.where(F.col("place") <= limit)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth): nodes within ``depth`` steps of each seed, by their least depth; the seed is left out.

    One join and one anti-join per step; each frontier is written out, so a step never repeats the ones before."""
    frontier = materialize(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct(), "frontier")
    seen = frontier
    edges = edges.select("src", "dst").distinct()
    for step in range(1, depth + 1):
        ahead = frontier.join(edges, frontier["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = materialize(ahead.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def bounded_reach(edges: DataFrame, seeds: DataFrame, depth: int, fanout: int, cap: int) -> DataFrame:
    """(seed, node, depth, place): what a breadth-first walk from each seed finds, in the order of finding.

    A node's first ``fanout`` edges by target count, duplicates among them; the walk ends at ``cap`` nodes. The seed itself
    is no find. A seed never holds more than ``cap`` rows and asks ``cap * fanout`` edges a step, however large the graph."""
    near = materialize(neighbours(edges.select("src", "dst"), fanout).withColumnRenamed("place", "edge"), "near")
    first = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"), F.lit(0).alias("place")).distinct()
    frontier = seen = materialize(first, "walk")
    for step in range(1, depth + 1):
        found = seen.groupBy("seed").agg(F.max("place").alias("found")).where(F.col("found") < cap)
        ahead = frontier.join(near, frontier["node"] == near["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.struct("place", "edge")).alias("via"))
        ahead = ahead.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").join(found, "seed")
        place = F.col("found") + F.row_number().over(Window.partitionBy("seed").orderBy("via"))
        frontier = materialize(ahead.select("seed", "node", F.lit(step).alias("depth"), place.alias("place")).where(F.col("place") <= cap), "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def call_graph(edges: DataFrame, seeds: DataFrame, asked: int, depth: int, fanout: int, cap: int) -> DataFrame:
    """(seed, n_nodes, n_edges, trim_reasons) of the bounded graph around each seed; edges are a bag, the seed is a node."""
    steps = min(asked, depth)
    first = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct()
    nodes = first.unionByName(bounded_reach(edges, seeds, steps, fanout, cap).select("seed", "node", "depth"))
    degree = neighbours(edges.select("src", "dst"), fanout).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    sized = nodes.join(degree, nodes["node"] == degree["src"], "left").withColumn("_edges", F.when(F.col("depth") < steps, F.coalesce("degree", F.lit(0))).otherwise(0))
    grouped = sized.groupBy("seed").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("_edges").alias("n_edges"))
    reasons = F.array_compact(F.array(F.when(F.lit(asked > depth), "call_depth_limited"), F.when(F.col("n_nodes") > cap, "callee_count_limited")))
    return grouped.withColumn("trim_reasons", reasons)


def edge_kind(opcode: Column, at: Column, target: Column, jumps: Column) -> Column:
    """The label of a control-flow edge from the instruction at ``at`` to ``target``; ``jumps`` are its own targets."""
    own, following = F.array_contains(jumps, target), target == at + 1
    return (
        F.when((opcode == "BrTrue") & own, "true").when((opcode == "BrTrue") & following, "false")
        .when((opcode == "BrFalse") & own, "false").when((opcode == "BrFalse") & following, "true")
        .when(opcode == "Branch", "branch").when((opcode == "VariantSwitch") & own, "variant")
        .when(following, "fallthrough").otherwise("successor")
    )


def positional_ids(edges: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """Add ``id`` (``kind:index:src:dst``), the index being the edge's place in the whole order.

    Rows are cut into ranges and written; each range counts from the number of rows in the ranges before it. Only those
    counts, one for each range, meet in one place."""
    ranges = materialize(edges.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    named = ranges.join(F.broadcast(offsets), "_range").withColumn("id", F.concat_ws(":", F.lit(kind), place, "src", "dst"))
    return named.drop("_range", "_before")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): everything reachable from each seed but itself, to the fixpoint."""
    reached, components = component_closure(edges, seeds)
    return reached.join(components, "component").select("seed", "node").where("seed <> node")


def reverse_paths(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(target, caller, depth, path): for each caller its shortest path to the target, the least of equal ones."""
    frontier = targets.select(F.col("node").alias("target"), F.col("node").alias("caller"), F.lit(0).alias("depth"), F.array("node").alias("path"))
    frontier = materialize(frontier, "paths")
    seen = frontier
    edges = edges.select("src", "dst").distinct()
    for step in range(1, depth + 1):
        ahead = frontier.join(edges, frontier["caller"] == edges["dst"]).select("target", F.col("src").alias("caller"), F.concat(F.array("src"), "path").alias("path"))
        ahead = ahead.groupBy("target", "caller").agg(F.min("path").alias("path")).withColumn("depth", F.lit(step))
        ahead = ahead.join(seen.select("target", "caller"), ["target", "caller"], "left_anti").select("target", "caller", "depth", "path")
        frontier = materialize(ahead, "paths")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both in ``nodes``."""
    own = nodes.select("node").distinct()
    edges = edges.join(own, edges["src"] == own["node"], "left_semi")
    return edges.join(own, edges["dst"] == own["node"], "left_semi")


def successors(blocks: DataFrame) -> DataFrame:
    """Control-flow edges between the blocks (fn, start, end, target) of a function: branch targets and falling through."""
    ordered = Window.partitionBy("fn").orderBy("start")
    falls = blocks.withColumn("to", F.lead("start").over(ordered)).where("to IS NOT NULL").select("fn", F.col("start").alias("src"), F.col("to").alias("dst"), F.lit("fallthrough").alias("kind"))
    jumps = blocks.where("target IS NOT NULL").select("fn", F.col("start").alias("src"), F.col("target").alias("dst"), F.lit("branch").alias("kind"))
    return falls.unionByName(jumps)


def keyed_edges(rows: DataFrame, keys: Sequence[str], kept: Sequence[str], order: Sequence[str], span: str) -> DataFrame:
    """(keys, kept, n_spans, first_span, last_span): one edge for each key, of which null parts are equal.

    What is kept is what the key's first row by ``order`` says. Spans are counted and bounded, not gathered, so the edge of
    a common key is no larger than others; the spans themselves stay rows of ``rows``."""
    first = F.min(F.struct(*order, *kept))
    found = rows.groupBy(*keys).agg(first.alias("_first"), F.count(F.lit(1)).alias("n_spans"), F.min(span).alias("first_span"), F.max(span).alias("last_span"))
    return found.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in kept), "n_spans", "first_span", "last_span")
