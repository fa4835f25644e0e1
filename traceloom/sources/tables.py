"""Tabular jobs, partitioned fact tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A document that is stored as evidence has at most so many bytes.
MOST_BYTES = 512 * 1024


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; no byte-order mark, no rows without any value."""
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=True, encoding="UTF-8")
    rows = rows.toDF(*(name.lstrip("﻿") for name in rows.columns))
    return rows.where(F.coalesce(*(F.when(F.trim(c) != "", F.lit(True)) for c in rows.columns), F.lit(False)))


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted where needed, quotes doubled."""
    rows.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', emptyValue="")


def job_items(rows: DataFrame, order: Sequence[str], id_column: str | None = None) -> DataFrame:
    """(row_index, source_id, item_id, row_json): items of a job; repeated ids get -2, -3 ... in order."""
    given = rows.columns
    numbered = rows.withColumn("row_index", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    key = F.col(id_column) if id_column else F.concat(F.lit("row-"), (F.col("row_index") + 1).cast("string"))
    numbered = numbered.withColumn("source_id", F.coalesce(key, F.lit("row")))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("row_index"))
    name = F.when(place == 1, F.col("source_id")).otherwise(F.concat("source_id", F.lit("-"), place.cast("string")))
    return numbered.select("row_index", "source_id", name.alias("item_id"), F.to_json(F.struct(*given)).alias("row_json"))


def fill_template(template: str, columns: Sequence[str]) -> Column:
    """``{column}`` replaced by its value, ``{{`` and ``}}`` by braces."""
    text = F.replace(F.replace(F.lit(template), F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name in columns:
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.replace(F.replace(text, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def replace_packages(rows: DataFrame, path: str) -> None:
    """Write fact rows so that they replace what the table has of their packages, and nothing else."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package_id").parquet(path)


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of both tables, for each key the latest one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def update_by_key(current: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """``current`` with ``columns`` set to what the last change of a row's key says, null included.

    Changes of unknown keys add nothing and other columns stay. Among changes of one ``order`` the greatest values count."""
    last = changes.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("_new"))
    changed = F.col("_new").isNotNull()
    joined = current.join(last, key, "left")
    return joined.select(*(F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


def write_documents(rows: DataFrame, path: str, body: str) -> DataFrame:
    """Store JSON documents of up to MOST_BYTES, never over others; returns the rows that are too large."""
    rows.where(F.octet_length(body) <= MOST_BYTES).write.mode("errorifexists").json(path)
    return rows.where(F.octet_length(body) > MOST_BYTES)


def rollouts(spark: SparkSession, path: str) -> DataFrame:
    """(thread, started, cwd, provider, records, last): a summary of each event log, from its first records."""
    schema = "timestamp timestamp, type string, payload struct<id:string,cwd:string,model_provider:string>"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(path).withColumn("thread", F.col("_metadata.file_path"))
    meta = F.when(F.col("type") == "session_meta", F.col("payload"))
    found = rows.groupBy("thread").agg(
        F.min("timestamp").alias("started"), F.min_by(meta, F.when(meta.isNotNull(), F.col("timestamp"))).alias("meta"), F.count(F.lit(1)).alias("records"), F.max("timestamp").alias("last")
    )
    return found.select("thread", "started", F.col("meta.cwd").alias("cwd"), F.col("meta.model_provider").alias("provider"), "records", "last")


def report_lines(findings: DataFrame) -> DataFrame:
    """(value): a Markdown list of (severity, title, target), the severest first."""
    from traceloom.functions.scoring import ranked

    rank = ranked(F.col("severity"), {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0})
    line = F.concat(F.lit("- **"), "severity", F.lit("** "), "title", F.lit(" ("), F.coalesce("target", F.lit("-")), F.lit(")"))
    return findings.orderBy(rank.desc(), "title", "target").select(line.alias("value"))
