"""Conversation histories: usage since the model last spoke, and dropping of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Sums stay at the largest number rather than fail.
MOST = (1 << 63) - 1


def usage_after(rows: DataFrame, key: str, order: str, model: Column, cost: str) -> DataFrame:
    """(key, after_model, total): cost of the rows behind the last one of the model, none if it never spoke, and of all."""
    last = F.max(F.when(model, F.col(order))).over(Window.partitionBy(key))
    behind = F.col(order) > F.col("_last")
    return rows.withColumn("_last", last).groupBy(key).agg(F.coalesce(F.sum(F.when(behind, F.col(cost))), F.lit(0)).alias("after_model"), F.sum(cost).alias("total"))


def token_totals(rows: DataFrame, key: str, order: str, model: Column, boundary: Column, encrypted: Column, tokens: str, size: str, usage: str) -> DataFrame:
    """(key, last_usage, all_bytes, tokens_since, bytes_since, reasoning, total, total_if_counted) of each history.

    ``usage`` is what a server reported with a row, if anything; the last report counts, 0 without one. Rows behind the last
    model row are not in it. Encrypted reasoning ahead of the last user boundary is estimated on top, unless the server has
    counted it already (total_if_counted). Null costs count as 0; sums stop at MOST."""
    whole = Window.partitionBy(key)
    marked = rows.withColumn("_model", F.max(F.when(model, F.col(order))).over(whole)).withColumn("_user", F.max(F.when(boundary, F.col(order))).over(whole))
    since = F.col(order) > F.col("_model")
    limit = F.lit(MOST).cast("decimal(38,0)")

    def total(cost: str, where: Column | None = None) -> Column:
        value = F.coalesce(F.col(cost).cast("decimal(20,0)"), F.lit(0))
        return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0)).cast("decimal(38,0)")

    found = marked.groupBy(key).agg(
        F.coalesce(F.max_by(usage, F.when(F.col(usage).isNotNull(), F.col(order))), F.lit(0)).cast("decimal(38,0)").alias("last_usage"), total(size).alias("all_bytes"),
        total(tokens, since).alias("tokens_since"), total(size, since).alias("bytes_since"), total(tokens, encrypted & (F.col(order) < F.col("_user"))).alias("reasoning"),
    )
    counted = F.col("last_usage") + F.col("tokens_since")
    sums = found.withColumn("total", counted + F.col("reasoning")).withColumn("total_if_counted", counted)
    return sums.select(key, *(F.least(F.col(c), limit).cast("long").alias(c) for c in sums.columns if c != key))


def drop_last_turns(rows: DataFrame, key: str, order: str, user: Column, n: int) -> DataFrame:
    """Rows up to the n-th last user turn; with fewer turns, what precedes the first."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumn("_seen", F.sum(user.cast("int")).over(running)).withColumn("_all", F.sum(user.cast("int")).over(Window.partitionBy(key)))
    return counted.where(F.col("_seen") <= F.greatest(F.lit(0), F.col("_all") - n)).drop("_seen", "_all")
