"""Queries by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL for it where there is one."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that sorts a table by its keys.
TASK_ROWS = 200_000


def tasks_for(of: DataFrame, rows: int | None = None) -> int:
    """How many tasks of TASK_ROWS (or ``rows``) rows a stored table asks for; the count is read from the files' footers."""
    return max(of.sparkSession.sparkContext.defaultParallelism, -(-of.count() // (rows or TASK_ROWS)))


def spread(rows: DataFrame, of: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """``rows`` dealt out by keys into as many partitions as the stored table ``of`` asks for, so that a task's rows, and what it
    sorts in memory, do not grow with the table."""
    return rows.repartition(tasks_for(of, each), *keys)


@query(
    "op_histogram",
    """
    SELECT p_brand AS function_brand, l_returnflag || l_linestatus AS kind, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
    """,
)
def op_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations per kind and owner."""
    from pyspark.sql import functions as F

    ops = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("kind"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("function_brand"))
    return ops.join(parts, ops.l_partkey == parts.p_partkey).groupBy("function_brand", "kind").agg(F.count(F.lit(1)).alias("n"))
