"""Tables that cut lineage, in the folder that every executor shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written within the open ``scratch_tables``, innermost last.
_WRITTEN: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of the scratch folder, wherever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes within are deleted at the end; for callers that have written their result."""
    written: list[str] = []
    _WRITTEN.append(written)
    try:
        yield
    finally:
        _WRITTEN.pop()
        for path in written:
            drop(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Have shuffle files of finished jobs deleted: Spark's cleaner does so when the driver has collected their plans, which a
    driver with memory to spare may not do for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet and read it back, so that a lost executor repeats no earlier stage. To ``keep`` is to
    leave the table to the next outer ``scratch_tables``, if there is one."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    lists = _WRITTEN[:-1] if keep else _WRITTEN
    if lists:
        lists[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
