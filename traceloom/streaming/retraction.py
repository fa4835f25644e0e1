"""Turns that later events take back, across batches of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rollbacks(StatefulProcessor):
    """Keeps each key's turns that stand as a stack, a place at a time: a batch touches only the places that it adds or takes
    back, however long the history is. Rows are (key, at, n): a turn, or a rollback of the last n turns that stand."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.height = handle.getValueState("height", "n bigint")
        self.turns = handle.getMapState("turns", "place bigint", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        height = self.height.get()[0] if self.height.exists() else 0
        began, added, gone = height, [], []
        for at, n in zip(batch["at"].tolist(), batch["n"].tolist()):
            if n != n or n is None:
                added.append(at)
                continue
            fresh = min(int(n), len(added))
            del added[len(added) - fresh :]
            for _ in range(min(int(n) - fresh, height)):
                height -= 1
                gone.append(self.turns.getValue((height,))[0])
                self.turns.removeKey((height,))
        for at in added:
            self.turns.updateValue((height,), (at,))
            height += 1
        if height != began or gone or added:
            self.height.update((height,))
            yield pd.DataFrame({"key": key[0], "at": gone + added, "stands": [False] * len(gone) + [True] * len(added)})

    def close(self) -> None:
        pass


def rollback_changes(rows: DataFrame, key: str, order: str, n: str) -> DataFrame:
    """(key, order, stands) as a stream of changes: a turn begins to stand, or one of an earlier batch is taken back. Turns that
    their own batch takes back never show. Batches come in the order of rows; rows of one batch are put in order."""
    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("at"), F.col(n).cast("double").alias("n"))
    changes = given.groupBy("key").transformWithStateInPandas(Rollbacks(), f"key {kind}, at bigint, stands boolean", "Update", "None")
    return changes.select(F.col("key").alias(key), F.col("at").alias(order), "stands")


def keep_changes(changes: DataFrame, folder: str) -> StreamingQuery:
    """Write each batch of changes under its own number, over what an earlier try of it left; ends with what there is."""
    spark = changes.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def standing(spark: SparkSession, folder: str, key: str, order: str) -> DataFrame:
    """(key, order): the turns that stand after all batches so far; a turn's last change counts."""
    changes = spark.read.parquet(f"{folder}/changes")
    return changes.groupBy(key, order).agg(F.max_by("stands", "batch").alias("stands")).where("stands").select(key, order)
