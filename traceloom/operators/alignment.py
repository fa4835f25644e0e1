"""Fuzzy search: the best paths for each query of a table, by their best alignment with the query.

A query's characters have to stand in a path in their order. Of all ways to place them, the best counts: MATCH for each
character, BOUNDARY more where one begins a word, RUN more where one follows the one before directly, and for a gap GAP and
EXTEND for each further character in it. A query with an upper-case letter matches by case, others in any case.

Queries go to the paths in blocks of BLOCK; a set of characters as bits rules most paths out before any is aligned, and
alignments advance by one character of the query for all paths of a batch at once. A task hands on the best ``limit`` paths
of each query, so that what is shuffled does not grow with the paths of a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Points of an alignment, and how many paths a query finds.
MATCH, BOUNDARY, RUN, GAP, EXTEND = 16, 8, 4, 3, 1
LIMIT = 50
#: Queries that are sent at once, and characters of paths that are aligned at once.
BLOCK, CELLS = 1_000, 1 << 20
_NONE = np.int32(-(1 << 29))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _mask(points: np.ndarray) -> int:
    """64 bits that tell which characters there are, by their remainder."""
    return int(np.bitwise_or.reduce(np.uint64(1) << (points % 64).astype(np.uint64))) if len(points) else 0


def _simple(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


def align(paths: np.ndarray, bonus: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, places) of the best alignment with each row of characters (0 beyond its end); the score is below 0 where there
    is none. Of equal alignments, the one whose last characters stand first."""
    n = paths.shape[1]
    at = np.arange(n, dtype=np.int32)
    rows = []
    for j, char in enumerate(wanted):
        if j == 0:
            before = np.zeros(paths.shape, np.int32)
        else:
            last = rows[-1]
            before = np.full(paths.shape, _NONE, np.int32)
            before[:, 1:] = last[:, :-1] + RUN
            if n > 2:
                # The best of all places before the one before, less what the gap costs.
                far = np.maximum.accumulate(last + EXTEND * at, axis=1)[:, :-2] - EXTEND * (at[2:] - 2) - GAP
                before[:, 2:] = np.maximum(before[:, 2:], far)
        rows.append(np.where(paths == char, np.maximum(before, _NONE) + MATCH + bonus, _NONE))
    score = rows[-1].max(1)
    places = np.zeros((len(wanted), len(paths)), np.int32)
    every = np.arange(len(paths))
    places[-1] = rows[-1].argmax(1)
    for j in range(len(wanted) - 2, -1, -1):
        gap = places[j + 1][:, None] - at
        cost = np.where(gap == 1, RUN, -GAP - EXTEND * (gap - 2))
        places[j] = np.where(gap >= 1, rows[j] + cost, 2 * _NONE).argmax(1)
    return np.where(score > _NONE // 2, score, -1)[every], places.T


def fuzzy_search(paths: DataFrame, queries: DataFrame, id_col: str, path_col: str, limit: int = LIMIT) -> DataFrame:
    """(query, place, id, path, score, places): the best paths of each query (query: string), ties by path, then by id.

    Null and empty queries find nothing; a query that is given twice counts once; null paths are never found."""
    asked = sorted(r["query"] for r in queries.select(F.col("query")).where("length(query) > 0").distinct().toLocalIterator())
    id_type = dict(paths.dtypes)[id_col]
    schema = f"query string, id {id_type}, path string, score long, places array<int>"
    rows = paths.where(F.col(path_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(path_col).alias("path"))
    found = None
    for k in range(0, len(asked), BLOCK):
        part = rows.mapInArrow(_searcher(asked[k : k + BLOCK], limit), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = paths.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "path", "id")
    placed = found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)
    return placed.select("query", "place", F.col("id").alias(id_col), "path", "score", "places")


def _searcher(queries: list[str], limit: int):
    """A partition's function: its best paths for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for query in queries:
            by_case = query != query.lower()
            points = _points(query if by_case else _simple(query))
            asked.append((query, by_case, points, _mask(points)))
        best: dict[str, list[tuple]] = {query: [] for query in queries}
        for batch in batches:
            ids, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in _runs([len(p) for p in paths]):
                own = paths[start:end]
                width = max(1, max(len(p) for p in own))
                cased, low = np.zeros((len(own), width), np.uint32), np.zeros((len(own), width), np.uint32)
                for i, p in enumerate(own):
                    cased[i, : len(p)], low[i, : len(p)] = _points(p), _points(_simple(p))
                word = np.zeros((len(own), width + 1), bool)
                word[:, 1:] = np.isin(low, _word_points(low))
                bonus = np.where(word[:, 1:] & ~word[:, :-1], BOUNDARY, 0).astype(np.int32)
                masks = {True: np.array([_mask(_points(p)) for p in own], np.uint64), False: np.array([_mask(_points(_simple(p))) for p in own], np.uint64)}
                for query, by_case, points, mask in asked:
                    near = np.flatnonzero(masks[by_case] & np.uint64(mask) == np.uint64(mask))
                    if not len(near):
                        continue
                    scores, places = align((cased if by_case else low)[near], bonus[near], points)
                    best[query] += [(-s, own[i], ids[start + i], p) for i, s, p in zip(near.tolist(), scores.tolist(), places.tolist()) if s >= 0]
                    if len(best[query]) > 4 * limit:
                        best[query] = _least(best[query], limit)
        out = [(query, i, path, -s, places) for query, own in best.items() for s, path, i, places in _least(own, limit)]
        columns = list(zip(*out)) or [()] * 5
        types = [pa.string(), batch.column(0).type if out else pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query", "id", "path", "score", "places"])

    return run


def _least(found: list[tuple], limit: int) -> list[tuple]:
    return sorted(found, key=lambda r: (r[0], r[1], r[2] is not None, r[2]))[:limit]


def _runs(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose table of characters has about CELLS cells."""
    start, widest = 0, 1
    for k, length in enumerate(lengths):
        widest = max(widest, length)
        if k > start and widest * (k + 1 - start) > CELLS:
            yield start, k
            start, widest = k, max(1, length)
    if start < len(lengths):
        yield start, len(lengths)


def _word_points(points: np.ndarray) -> np.ndarray:
    """Those of the characters that are letters or digits."""
    return np.array([c for c in np.unique(points).tolist() if c and chr(c).isalnum()], np.uint32)
