"""Keyed streaming operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# When a stream begins to catch up and when it has; milliseconds and lines.
ENTER_LINES, ENTER_AGE, EXIT_LINES, EXIT_AGE, HOLD = 8, 120, 2, 40, 250
SEVERE_LINES, SEVERE_AGE = 64, 300


def debounced(events: DataFrame, key: str, time: str, gap: str, delay: str = "1 minute") -> DataFrame:
    """One row for each burst of a key's events: its start, its end (the last event and the gap) and their number."""
    bursts = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return bursts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hysteresis(queue: DataFrame, key: str) -> DataFrame:
    """(key, at, mode): the mode of each key's queue after each sample (at, lines, age; milliseconds).

    A smooth stream starts to catch up when the queue is long or old, and is smooth again once it has been short and
    young for HOLD; after that it starts again within HOLD only if the queue is severe."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        catching, below, left = state.get if state.exists else (False, -1, -1)
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        modes = []
        for at, lines, age in zip(rows["at"], rows["lines"], rows["age"]):
            severe = lines >= SEVERE_LINES or age >= SEVERE_AGE
            if lines == 0 and catching:
                catching, below, left = False, -1, at
            elif not catching:
                if (lines >= ENTER_LINES or age >= ENTER_AGE) and (severe or left < 0 or at - left >= HOLD):
                    catching, below = True, -1
            elif lines <= EXIT_LINES and age <= EXIT_AGE:
                below = at if below < 0 else below
                if at - below >= HOLD:
                    catching, below, left = False, -1, at
            else:
                below = -1
            modes.append("catch_up" if catching else "smooth")
        state.update((bool(catching), int(below), int(left)))
        yield pd.DataFrame({key: name[0], "at": rows["at"], "mode": modes})

    kind = queue.schema[key].dataType.simpleString()
    return queue.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, at bigint, mode string", "catching boolean, below bigint, left_at bigint", "append", GroupStateTimeout.NoTimeout
    )


def idle(events: DataFrame, key: str, time: str, timeout_ms: int, done: str, delay: str = "0 seconds") -> DataFrame:
    """(key, n, outcome): streams that said they are done, or were idle for longer than the timeout in event time.

    A key's rows are walked in order of time, done last among equal times: each gap beyond the timeout and each done ends
    a stream, and the next row begins another, so the cut into batches does not matter as long as rows are not late. What
    is left open at the end stays open until the watermark is beyond its timeout."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        ended = []
        if state.hasTimedOut:
            ended.append((n, "idle"))
            state.remove()
        else:
            rows = pd.concat(list(parts))
            rows = rows.assign(_done=rows["event"] == done).sort_values(["_at", "_done"], kind="stable")
            for at, finished in zip(rows["_at"].tolist(), rows["_done"].tolist()):
                if n and at - last > timeout_ms * 1000:
                    ended.append((n, "idle"))
                    n, last = 0, at
                n, last = n + 1, max(last, at) if n else at
                if finished:
                    ended.append((n, "completed"))
                    n = 0
            if n:
                state.update((n, last))
                state.setTimeoutTimestamp(max(last // 1000 + timeout_ms, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        if ended:
            yield pd.DataFrame({key: [name[0]] * len(ended), "n": [n for n, _ in ended], "outcome": [o for _, o in ended]})

    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark(time, delay).withColumn("_at", F.unix_micros(F.col(time)))
    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, n bigint, outcome string", "n bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def forward(events: DataFrame, folder: str, every: str | None = "250 milliseconds") -> StreamingQuery:
    """Hand each batch of new events on as files below ``folder``/sent; runs until stopped, or ends with what there is (None).

    A batch is written under its own number over what an earlier try left, so none is sent twice after a failure; a
    receiver takes the folders in order of number. Progress is kept in ``folder``/state, which a restart goes on from."""

    def send(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/sent/batch={number:012}")

    pace = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(send).option("checkpointLocation", f"{folder}/state").trigger(**pace).start()


def high_water_mark(batch: DataFrame, column: str, before: int) -> int:
    """The largest value seen so far; never less than before. For ``foreachBatch``."""
    row = batch.agg(F.max(column).alias("m")).first()
    return max(before, row["m"] if row["m"] is not None else before)
