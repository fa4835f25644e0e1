"""Joins: resolution with fallbacks, as-of and range joins, anti-join fills and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def resolve_or_keep(rows: DataFrame, lookup: DataFrame, key: str, name: str, found: str, out: str) -> DataFrame:
    """Add ``out``: the lookup's ``found`` for the row's key, else the key itself as text."""
    table = lookup.select(F.col(name).alias("_name"), F.col(found).cast("string").alias("_found"))
    return rows.join(table, rows[key] == table["_name"], "left").withColumn(out, F.coalesce("_found", F.col(key).cast("string"))).drop("_name", "_found")


def resolve_two_tier(rows: DataFrame, targets: DataFrame, scope: str, name: str, target_id: str, out: str) -> DataFrame:
    """Exact (scope, name) first; for rows without a scope, a name that one target alone has."""
    exact = targets.groupBy(F.col(scope).alias("_scope"), F.col(name).alias("_name")).agg(F.min(target_id).alias("_exact"))
    unique = targets.groupBy(F.col(name).alias("_only")).agg(F.min(target_id).alias("_unique"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    joined = rows.join(exact, (rows[scope] == exact["_scope"]) & (rows[name] == exact["_name"]), "left")
    joined = joined.join(unique, (joined[name] == unique["_only"]) & joined[scope].isNull(), "left")
    return joined.withColumn(out, F.coalesce("_exact", "_unique")).drop("_scope", "_name", "_exact", "_only", "_unique")


def carry_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """Backward as-of join within a table: the last non-null ``value`` up to and including each row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(upto))


def first_following(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """The first non-null ``value`` behind each row."""
    behind = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(out, F.first(value, ignorenulls=True).over(behind))


def in_blocks(points: DataFrame, blocks: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Range join of points with non-overlapping blocks of their keys (``start <= at < end``).

    Both sides are sorted together once per key and the last block start is carried forward, so a key costs its rows,
    not their product."""
    own = [*keys]
    rest = [c for c in blocks.columns if c not in own]
    tagged = points.withColumn("_block", F.lit(None).cast(blocks.select(F.struct(*rest).alias("s")).schema["s"].dataType)).withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1))
    opening = blocks.select(*own, F.struct(*rest).alias("_block"), F.col(start).alias("_at"), F.lit(0).alias("_kind"))
    both = tagged.unionByName(opening, allowMissingColumns=True)
    both = carry_forward(both, own, ["_at", "_kind"], F.col("_block"), "_block")
    return both.where((F.col("_kind") == 1) & (F.col("_at") < F.col(f"_block.{end}"))).select(*points.columns, "_block.*")


def fallback_fill(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``first``, and what ``second`` has for keys that it lacks, one row each."""
    missing = second.join(first.select(*keys), [*keys], "left_anti")
    order = Window.partitionBy(*keys).orderBy(*(c for c in second.columns if c not in keys))
    missing = missing.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.unionByName(missing)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dangling(rows: DataFrame, key: str, *targets: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key is in none of the target tables."""
    for table, column in targets:
        rows = rows.join(table.select(F.col(column).alias("_to")), rows[key] == F.col("_to"), "left_anti")
    return rows


def contains_all(have: Column, needed: Sequence[str]) -> Column:
    """Whether an array holds every needed value."""
    return F.size(F.array_except(F.array(*(F.lit(x) for x in needed)), have)) == 0


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison of two fingerprint tables: keys, old and new value, and whether they differ."""
    a = old.select(*keys, F.col(value).alias("old_value"))
    b = new.select(*keys, F.col(value).alias("new_value"))
    return a.join(b, [*keys], "full_outer").withColumn("refresh", ~F.col("old_value").eqNullSafe(F.col("new_value")))


def package_relationships(functions: DataFrame) -> DataFrame:
    """(source_module, source_function, target_module, target_function): who names which ``public(package)`` function.

    ``functions`` has (module, name, visibility, body). A body names a target where it holds ``module::name``, or, in the
    target's own module, ``name(``; both also count within longer names. Names are letters, digits and underscores, so
    a match ends or begins a run of them: the ends of runs before ``::`` and the beginnings after it are joined with the
    targets, and no caller meets a target that it does not name. Functions without a body call nothing."""
    targets = functions.where("visibility = 'public(package)' AND module IS NOT NULL AND name IS NOT NULL")
    targets = targets.select(F.col("module").alias("target_module"), F.col("name").alias("target_function")).distinct()
    callers = functions.where("body IS NOT NULL").select(F.col("module").alias("source_module"), F.col("name").alias("source_function"), "body")
    heads = lambda run: F.transform(F.sequence(F.lit(1), F.length(run)), lambda n: F.substr(run, F.lit(1), n))
    tails = lambda run: F.transform(F.sequence(F.lit(1), F.length(run)), lambda n: F.substr(run, n))

    path = F.lit(r"(?<![A-Za-z0-9_])([A-Za-z0-9_]++)::(?=([A-Za-z0-9_]+))")
    runs = F.array_distinct(F.arrays_zip(F.regexp_extract_all("body", path, F.lit(1)).alias("left"), F.regexp_extract_all("body", path, F.lit(2)).alias("right")))
    named = callers.select("source_module", "source_function", F.explode(runs).alias("run")).distinct()
    named = named.select("source_module", "source_function", F.col("run.left").alias("left"), F.explode(heads(F.col("run.right"))).alias("target_function"))
    named = named.join(targets.select("target_function").distinct(), "target_function", "left_semi")
    named = named.select("source_module", "source_function", F.explode(tails(F.col("left"))).alias("target_module"), "target_function")

    called = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?<![A-Za-z0-9_])([A-Za-z0-9_]++)\("), F.lit(1)))
    own = callers.select("source_module", "source_function", F.explode(called).alias("run")).distinct()
    own = own.select("source_module", "source_function", F.col("source_module").alias("target_module"), F.explode(tails(F.col("run"))).alias("target_function"))
    return named.unionByName(own).join(targets, ["target_module", "target_function"], "left_semi").select("source_module", "source_function", "target_module", "target_function").distinct()
