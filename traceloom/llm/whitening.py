"""Whitening of embeddings by cyclic Jacobi rotations.

Vectors are rounded to integers, so that counts and sums are exact. Tasks add up their rows' scatter about the corpus'
mean, each row centred before it is multiplied, and the partial matrices are added row by row of the matrix; the driver holds
one matrix of the vectors' width. There, symmetric Jacobi rotations turn every pair of dimensions in cycles until the entries
off the diagonal vanish; rotations never mix large numbers into small ones, so small eigenvalues keep their relative
precision. Components are sorted by falling eigenvalue, and the whitening matrix (width x components) is broadcast.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; all others have to have
one width, else the job fails with a message that says so; entries are below 2^44 in size, else it fails likewise; rows without an id
and rows that repeat are vectors like others; a component without variance (below WITHOUT of the largest eigenvalue) is
whitened to 0 and left out of identity_error; explained is 0 where nothing varies; a deviation beyond a long is null; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import materialize, tidy

#: Steps of an entry's grid, and what is added.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Part of the largest eigenvalue below which there is no variance but rounding.
WITHOUT = 1e-13
_LARGE = float(1 << 50)


def whole_numbers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that take part, as arrays of long."""
    value = F.col("v").cast("array<double>")
    sound = value.isNotNull() & (F.size(value) > 0) & ~F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.coalesce(sound, F.lit(False)))
    scaled = F.transform(value, lambda c: F.floor(c * SCALE) + SHIFT)
    return rows.select("vec_id", F.when(F.exists(value, lambda c: F.abs(c * SCALE) > _LARGE), F.raise_error(F.lit("an entry is 2^44 or larger"))).otherwise(scaled).alias("x"))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    if not len(lists):
        return np.empty((0, 0), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and their exact sums by dimension."""
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes["n"] and sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors have widths from {sizes['least']} to {sizes['most']}; whitening needs one width")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two halves of each number are added apart, so that no sum of a task overflows.
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                own = np.stack([(x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)])
                total = own if total is None else total + own
        if total is not None:
            d = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["i", "high", "low"])

    parts = rows.select("x").mapInArrow(tidy(add), "i int, high long, low long")
    exact = parts.groupBy("i").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found = {r["i"]: (int(r["high"]) << 26) + int(r["low"]) for r in exact.collect()}
    return sizes["n"], [found[i] for i in range(len(found))]


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' matrices (part, i, row): rows of the matrix meet, and are added in the parts' order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["i", "row"])
        for batch in batches:
            for at, row in zip(batch.column(0).to_pylist(), _matrix(batch, "row") if batch.num_rows else ()):
                if at == i:
                    total = total + row
                else:
                    if i is not None:
                        yield out()
                    i, total = at, row
        if i is not None:
            yield out()

    summed = parts.repartition("i").sortWithinPartitions("i", "part").select("i", "row").mapInArrow(tidy(add), "i int, row array<double>")
    rows = {r["i"]: r["row"] for r in summed.collect()}
    return np.array([rows[i] for i in range(len(rows))])


def _scatter(rows: DataFrame, centred) -> np.ndarray:
    """The sum of the rows' outer products after ``centred``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                y = centred(_matrix(batch))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            d = len(total)
            columns = [pa.array([TaskContext.get().partitionId()] * d, pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "i", "row"])

    return _added(rows.select("x").mapInArrow(tidy(run), "part int, i int, row array<double>"))


def jacobi(matrix: np.ndarray, most_cycles: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A pair of dimensions is turned while its entry counts beside its two diagonal entries; cycles go on until none does."""
    a, vectors = np.array(matrix, np.float64), np.eye(len(matrix))
    eps, floor = np.finfo(float).eps, np.finfo(float).tiny
    for _ in range(most_cycles):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= max(eps * np.sqrt(abs(a[p, p] * a[q, q])) / 4, floor):
                    continue
                turned = True
                apart = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.copysign(1.0, apart) / (abs(apart) + np.hypot(1.0, apart))
                c = 1 / np.hypot(1.0, t)
                s, shift = t * c, t * a[p, q]
                low, high = a[p, p] - shift, a[q, q] + shift
                one, two = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = one, two
                a[:, p], a[:, q] = one, two
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                vp, vq = vectors[:, p].copy(), vectors[:, q]
                vectors[:, p], vectors[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    else:
        raise ArithmeticError("Jacobi rotations did not end")
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(embeddings, id_col, vector_col)
    n, sums = _sums(rows)
    if not n:
        return spark.createDataFrame([], schema)
    # x - S/n is (x - whole) - rest/n, with small numbers only.
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    share = np.array([float(Fraction(s % n, n)) for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - share

    values, vectors = jacobi(_scatter(rows, centred) / n)
    values = np.maximum(values, 0.0)
    k, trace = min(components, len(values)), float(values.sum())
    varies = values[:k] > WITHOUT * values[0]
    shared = spark.sparkContext.broadcast(vectors[:, :k] * np.where(varies, 1 / np.sqrt(np.where(varies, values[:k], 1.0)), 0.0))
    explained = values[:k] / trace if trace else np.zeros(k)

    # What the rows become is measured on the rows themselves: their own mean, then their scatter about it.
    means = _means(rows, lambda x: centred(x) @ shared.value) / n
    identity = _scatter(rows, lambda x: centred(x) @ shared.value - means) / n - np.eye(k)
    error = float(np.abs(identity[np.ix_(varies, varies)]).max()) if varies.any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            y, m = centred(x) @ shared.value, len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n, np.int64)),
                _deviations(x - whole, rest, n).take(pa.array(np.repeat(np.arange(m), k))), pa.array(y.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(run), schema)


def _means(rows: DataFrame, of) -> np.ndarray:
    """The sum of the rows after ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(_matrix(batch)).sum(0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "i", "row"])

    return _added(rows.select("x").mapInArrow(tidy(run), "part int, i int, row array<double>"))[0]


def _deviations(off: np.ndarray, rest: np.ndarray, n: int) -> pa.Array:
    """The sums of (n * off - rest)^2 by row, exact; null beyond a long."""
    most = n * (int(np.abs(off).max()) + 1)
    if most * most * off.shape[1] < 2**63:
        return pa.array(((n * off - rest) ** 2).sum(1))
    rest = [int(r) for r in rest]
    exact = (sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in off.tolist())
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())
