"""Set containment joins: sets against all sets that hold every item of theirs.

Sets are rows with an array of items; null items and an item's repeats count for nothing, a null array is empty. Equal sets
are one class from the start. The asking classes are looked up by their rarest item among the answering ones; where that would
compare more pairs than longer keys make rows, they are looked up by their two rarest items, and so on. A class whose items are
all in its key needs no comparison: its answer is a count. So no group compares more than WORK pairs for each item of its sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from traceloom.scratch import materialize

#: Comparisons in a group for each row that longer keys would make of it, beyond which keys get longer.
WORK = 4

#: Longer keys that a task holds in memory.
TASK_KEYS = 50_000


def item_set(items: Column, kind: str = "array<string>") -> Column:
    """A set's items, each once, ascending."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(items.cast(kind), F.array().cast(kind)))))


def superset_counts(asking: DataFrame, answering: DataFrame, key: str = "id", items: str = "items", work: int = WORK) -> DataFrame:
    """(key, n_items, n_supersets): for each asking row the size of its set, and how many answering rows hold all of it; 0 for
    none, all for no items."""
    whole = all(df.schema[items].dataType.simpleString() in ("array<int>", "array<bigint>") for df in (asking, answering))
    kind = "array<bigint>" if whole else "array<string>"
    ask = materialize(asking.select(key, item_set(F.col(items), kind).alias("_set")), "asking")
    own = answering.select(item_set(F.col(items), kind).alias("_set")).groupBy("_set").agg(F.count(F.lit(1)).alias("_n"))
    own = materialize(own, "answering")

    # How common each item is among the answering classes; items without a count make their set unanswerable. Of a key of one
    # item this is all there is to count: its classes and rows, and the rows that keys of two would make of them.
    common = own.select("_n", (F.size("_set") - 1).alias("_more"), F.explode("_set").alias("_item")).groupBy("_item")
    common = materialize(common.agg(F.count(F.lit(1)).alias("_right"), F.sum("_n").alias("_total"), F.sum("_more").alias("_wide")), "items")
    counts = common.withColumn("_key", F.array("_item")).drop("_item")
    placed = ask.where(F.size("_set") > 0).select("_set").distinct()
    wanted = placed.select("_set", F.explode("_set").alias("_item")).join(common.select("_item", F.col("_right").alias("_seen")), "_item")
    ordered = wanted.groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("_seen", "_item"))).alias("_by"))
    left = ordered.where(F.size("_by") == F.size("_set")).select("_set", F.transform("_by", lambda x: x["_item"]).alias("_by"))
    left = materialize(left.withColumn("_key", F.slice("_by", 1, 1)), "level")
    right = own.select(F.col("_set").alias("_held"), "_n", F.explode("_set").alias("_item")).withColumn("_key", F.array("_item")).drop("_item")

    found, depth = None, 1
    while True:
        # Sets that are their own key: all rows of the key answer.
        full = left.where(F.size("_by") == depth).select("_set", "_key")
        done = full.join(counts, "_key").select("_set", F.col("_total").alias("n_supersets"))
        rest = left.where(F.size("_by") > depth)
        groups = rest.groupBy("_key").agg(F.count(F.lit(1)).alias("_left")).join(counts, "_key")
        groups = materialize(groups.select("_key", (F.col("_left") * F.col("_right") > work * (F.col("_left") + F.col("_wide"))).alias("_hot")), "groups")
        calm, hot = groups.where("NOT _hot").select("_key"), groups.where("_hot").select("_key")
        met = rest.join(calm, "_key").join(right, "_key")
        met = met.where(F.size(F.array_except("_by", "_held")) == 0).groupBy("_set").agg(F.sum("_n").alias("n_supersets"))
        level = materialize(done.unionByName(met), "found")
        found = level if found is None else found.unionByName(level)
        if hot.isEmpty():
            break
        depth += 1
        left = materialize(rest.join(hot, "_key").withColumn("_key", F.slice("_by", 1, depth)), "level")
        # Rows of a hot key go on with each of their other items, where an asking set has that key.
        more = right.join(hot, "_key").select("_held", "_n", "_key", F.explode(F.array_except("_held", "_key")).alias("_item"))
        more = more.select("_held", "_n", F.array_append("_key", F.col("_item")).alias("_key"))
        # The asked keys fit a task's memory, by their number; the rows that are held against them stream past unsorted.
        tasks = max(own.sparkSession.sparkContext.defaultParallelism, -(-left.count() // TASK_KEYS))
        asked = left.select("_key").repartition(tasks, "_key").distinct().hint("shuffle_hash")
        right = materialize(more.repartition(tasks, "_key").join(asked, "_key", "left_semi"), "level")
        sums = F.count(F.lit(1)).alias("_right"), F.sum("_n").alias("_total"), F.sum(F.size("_held") - depth).alias("_wide")
        counts = materialize(right.groupBy("_key").agg(*sums), "counts")
    total = own.agg(F.sum("_n")).first()[0] or 0
    answer = F.when(F.size("_set") == 0, F.lit(total)).otherwise(F.coalesce("n_supersets", F.lit(0))).cast("long")
    return ask.join(found, "_set", "left").select(key, F.size("_set").cast("long").alias("n_items"), answer.alias("n_supersets"))
