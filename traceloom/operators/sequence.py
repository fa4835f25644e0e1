"""Operators on ordered rows: numbering, blocks, budgets, turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.scratch import materialize


def suffix_duplicates(rows: DataFrame, key: str, order: Sequence[Column | str], out: str) -> DataFrame:
    """Names that are made different by ``-2``, ``-3`` ... in arrival order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    name = F.col(key).cast("string")
    return rows.withColumn(out, F.when(place == 1, name).otherwise(F.concat(name, F.lit("-"), place.cast("string"))))


def blocks(rows: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Maximal runs of one value: keys, block, start, end (positions), value, size."""
    ordered = Window.partitionBy(*keys).orderBy(position)
    leads = ~F.col(value).eqNullSafe(F.lag(value).over(ordered)) | (F.row_number().over(ordered) == 1)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_lead", leads.cast("int")).withColumn("block", (F.sum("_lead").over(running) - 1).cast("long"))
    return numbered.groupBy(*keys, "block").agg(
        F.min(position).alias("start"), F.max(position).alias("end"), F.min(value).alias("kind"), F.count(F.lit(1)).alias("size")
    )


def newest_within_budget(rows: DataFrame, keys: Sequence[str], newest_first: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Rows from the newest on until the budget is used up; the last one kept is cut to what is left of it."""
    upto = Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(upto), F.lit(0))
    return rows.withColumn("_spent", spent).where(F.col("_spent") < budget).withColumn("kept", F.least(F.col(cost), budget - F.col("_spent"))).drop("_spent")


def before_nth(rows: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column, n: int) -> DataFrame:
    """Rows before the n-th marked row (all, if there are fewer)."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_seen", F.sum(marker.cast("int")).over(running)).where(F.col("_seen") < n).drop("_seen")


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column, n: int) -> DataFrame:
    """Rows from the n-th last marked row on."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    marked = rows.withColumn("_seen", F.sum(marker.cast("int")).over(running)).withColumn("_all", F.sum(marker.cast("int")).over(whole))
    return marked.where(F.col("_seen") > F.col("_all") - n).drop("_seen", "_all")


def head_tail(text: Column, budget: int) -> tuple[Column, Column, Column]:
    """The first half of a byte budget, the other half from the end of the rest, and how many bytes lie between."""
    head = budget // 2
    tail = budget - head
    size = F.octet_length(text)
    rest = F.greatest(F.lit(0), size - head)
    data = text.cast("binary")
    first = F.substring(data, 1, head)
    last = F.substr(data, F.greatest(F.lit(head) + 1, size - tail + 1), F.least(F.lit(tail), rest))
    return first, last, F.greatest(F.lit(0), rest - tail).cast("long")


def group_head_tail(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """(key, head, tail, omitted): ``head_tail`` of the texts of each key put together, null being empty.

    Running sums of bytes tell what of a row lies in the head and in the tail; only these pieces, which are no longer than the
    budget in all, meet in one place."""
    head, tail = budget // 2, budget - budget // 2
    size = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    sized = rows.select(key, order, F.col(text).cast("binary").alias("_data"), size.alias("_size"))
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).withColumn("_total", F.sum("_size").over(Window.partitionBy(key)))
    at = lambda c: c.cast("int")
    first = F.greatest(F.lit(head), F.col("_total") - tail)
    begins = F.greatest(F.lit(0), first - F.col("_before"))
    front = F.when((F.col("_size") > 0) & (F.col("_before") < head), F.substr("_data", F.lit(1), at(F.lit(head) - F.col("_before"))))
    back = F.when((F.col("_size") > 0) & (F.col("_before") + F.col("_size") > first), F.substr("_data", at(begins + 1), at(F.col("_size") - begins)))
    cut = placed.select(key, order, front.alias("_front"), back.alias("_back"), "_total")
    joined = lambda c: F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, F.hex(c).alias("h"))))), lambda x: x["h"]), ""))
    return cut.groupBy(key).agg(joined("_front").alias("head"), joined("_back").alias("tail"), F.greatest(F.lit(0), F.max("_total") - budget).cast("long").alias("omitted"))


def _with_heights(rows: DataFrame, key: str, order: str, change: Column) -> DataFrame:
    """Add ``_height``, the size of each key's stack after a row, and ``_lowest``, the least size after any later row.

    The stack never falls below empty: a sum's distance from its lowest point so far is the size. Running frames only,
    so that a key of any length takes one pass each way and spills."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_sum", F.sum(change).over(upto)).withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    return summed.withColumn("_lowest", F.min("_height").over(later)).drop("_sum")


_STANDS = "_lowest IS NULL OR _lowest >= _height"


def replay_rollbacks(rows: DataFrame, key: str, order: str, n_rolled_back: str) -> DataFrame:
    """Turns that survive: a row with ``n_rolled_back`` takes that many of the turns left before it away."""
    n = F.coalesce(F.col(n_rolled_back), F.lit(0))
    return _with_heights(rows, key, order, F.when(n == 0, 1).otherwise(-n)).where(n == 0).where(_STANDS).select(key, order)


def fork_turns(rows: DataFrame, key: str, order: str, turn: Column, fork: Column, n_rolled_back: Column) -> DataFrame:
    """Fork positions that survive: a rollback of n turns removes all of them from the n-th last turn on (from the first,
    if fewer are left; none, if no turn is left). A fork need not be a turn."""
    n = F.coalesce(n_rolled_back, F.lit(0))
    return _with_heights(rows, key, order, F.when(n > 0, -n).otherwise(turn.cast("int"))).where(fork & (n == 0)).where(_STANDS).select(key, order)


def page(rows: DataFrame, order: Sequence[Column | str], offset: int, limit: int = 100) -> DataFrame:
    """One page (of 1 to 200 rows) in a total order."""
    return rows.orderBy(*order).offset(offset).limit(min(200, max(1, limit)))


def page_before(rows: DataFrame, order: Sequence[str], cursor: Sequence, limit: int) -> DataFrame:
    """The page that ends before the cursor, in descending order of the columns: the nearest rows above it, turned round."""
    above = F.struct(*(F.col(c) for c in order)) > F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, cursor, strict=True)))
    return rows.where(above).orderBy(*order).limit(limit).orderBy(*(F.col(c).desc() for c in order))


def after_key(rows: DataFrame, key: str, cursor, limit: int, descending: bool = True) -> DataFrame:
    """Keyset pagination: the next rows beyond the cursor."""
    beyond = F.col(key) < cursor if descending else F.col(key) > cursor
    return rows.where(beyond).orderBy(F.col(key).desc() if descending else F.col(key)).limit(limit)


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``place`` (from 0) of each row by an order within its key; a key's rows may be spread over any number of tasks.

    Rows are cut into ranges of the whole order and written; each range counts on from what the ranges before it hold of the
    key that it continues, which is one row a range at most."""
    cut = materialize(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("_range", *(F.col(k).alias(f"_{k}") for k in keys), F.sum("_n").over(before).alias("_before")).where("_before IS NOT NULL").withColumnRenamed("_range", "_of")
    local = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = local.join(F.broadcast(carried), same, "left")
    return found.select(*rows.columns, (F.col("_at") - 1 + F.coalesce("_before", F.lit(0))).alias("place"))


def sequence_digests(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, n, digest): one digest for each key's rows in their order.

    Each row is hashed with its place, and four parts of 60 bits of these hashes are added, so digests of any ranges merge by
    addition, while another order, another row or a missing one gives another digest. Columns of ``order`` are what counts of a
    row; null is told from the empty text."""
    placed = places(rows.select(*keys, *order), keys, order)
    value = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in order]
    hashed = placed.select(*keys, F.sha2(F.concat_ws("|", F.col("place").cast("string"), *value), 256).alias("_hash"))
    parts = [F.sum(F.conv(F.substring("_hash", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"_{k}") for k in range(4)]
    sums = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(*keys, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.col(f"_{k}").cast("string") for k in range(4))), 256).alias("digest"))


def spans_of_edges(rows: DataFrame, keys: Sequence[str], span: Sequence[str]) -> DataFrame:
    """(keys, span, place, n_times): the distinct spans of each edge in order, numbered from 0, as rows of a table beside it."""
    distinct = rows.groupBy(*keys, *span).agg(F.count(F.lit(1)).alias("n_times"))
    return places(distinct, keys, span)


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: each row's number from 1 within its keys (not null), by ``order``. Rows are cut into ranges first and
    numbered within these, so that a key with very many rows is no single task; written once, as ranges are sampled."""
    placed = materialize(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return placed.withColumn("_own", own).join(offsets, [*keys, "_range"]).withColumn(name, F.col("_own") + F.col("_ahead")).drop("_own", "_ahead", "_range")
