"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are hashed by direction and ranked by inner product. Each table turns the unit vectors by pseudo-rotations,
three rounds of random signs and a fast Hadamard transform each, and takes the nearest signed axis after each rotation.
A vector's bucket is the tuple of its axes; the last one may be taken over fewer axes. How many there are follows from
the number of vectors, so that a bucket holds about BUCKET of them at every size, and the probes of a query grow with
a power of it below 1: the candidates of a query are a falling share of the table. A query probes the buckets whose axes lose
least against its own, summed over the rotations, and what it meets is ranked by exact inner products of the original
vectors in double precision.

Directions say nothing of norms, so vectors are first told apart by their length and by bands of norms (half powers of
two), and each band has buckets and probes of its own, by one rule at every size: the fewer vectors, the larger the share
of buckets that is probed, up to all of them for a few dozen outliers. A query that has met fewer than it needs is held
against all vectors of its length.

Equal vectors are one vector from here on: it stands for its smallest TOP + 1 ids, as ties go to smaller ids. Buckets
that follow each other form a group of about CANDIDATES vectors; a query goes to a group once, with all buckets that it
probes there. Groups that hold more than their share are cut in blocks of candidates and of queries by their counts, so
a hot bucket becomes many groups of bounded size, and a task hands on the best TOP + 1 of each of its queries.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part; vectors meet
only those of their own length; rows without an id take no part, rows that repeat id and vector count once; with fewer
than TOP candidates all are returned; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.llm.common import materialize, tidy

TOP = 20
TABLES = 4
#: Vectors of a bucket, about; the share of a table's buckets that a query probes in a band of 2,000 vectors, and the
#: power of the number of vectors with which this share falls.
BUCKET, PROBES, FALL = 4, 0.28, 0.42
#: Candidates and queries of one group.
CANDIDATES, QUERIES = 4_000, 2_000
#: Pairs whose products are taken at a time, and found ones that a task holds before it keeps the best of each query.
PAIRS, HELD = 20_000, 1_000_000
#: Vectors that are hashed at a time.
CHUNK = 256

PLACE = ["length", "band", "table", "coarse"]


@dataclass(frozen=True)
class Shape:
    """How a band is hashed: signed axes of each rotation, buckets of all of them together, probes and groups."""

    axes: tuple[int, ...]
    probes: int
    groups: int

    @property
    def buckets(self) -> int:
        return int(np.prod(self.axes, dtype=object)) if self.axes else 1

    def coarse(self, code: np.ndarray) -> np.ndarray:
        per = -(-self.buckets // self.groups)
        return code // per


def shape(count: int, length: int, probes: float = PROBES) -> Shape:
    """Enough axes for BUCKET vectors a bucket, and a falling share of the buckets probed."""
    full = 2 << max(0, length - 1).bit_length()
    wanted, axes = max(2, count // BUCKET), []
    while wanted > 1 and len(axes) < 8:
        axes.append(min(full, max(2, 1 << (wanted - 1).bit_length())))
        wanted //= axes[-1]
    own = Shape(tuple(axes), 1, 1)
    return Shape(own.axes, min(own.buckets, int(probes * own.buckets * (2_000 / count) ** FALL) + 1), max(1, min(own.buckets, round(count / CANDIDATES))))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """A pseudo-rotation; signs depend on its number alone."""
    signs = np.random.default_rng(number).choice([-1.0, 1.0], (3, x.shape[1]))
    for own in signs:
        x = hadamard(x * own)
    return x


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the width is a power of two. Divided by their largest component first, as squares can overflow."""
    width = 1 << (x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), width))
    scaled = x / np.abs(x).max(axis=1)[:, None]
    out[:, : x.shape[1]] = scaled / np.linalg.norm(scaled, axis=1)[:, None]
    return out


def bands(x: np.ndarray) -> np.ndarray:
    """The half power of two nearest to each norm."""
    most = np.abs(x).max(axis=1)
    return np.floor(2 * (np.log2(most) + np.log2(np.linalg.norm(x / most[:, None], axis=1))) + 0.5).astype(np.int32)


def _signed(x: np.ndarray, own: Shape, table: int, at: int) -> np.ndarray:
    """Of directions: how far each signed axis of a rotation lies in their way (2 k and 2 k + 1 are axis k, both signs)."""
    turned = rotate(x, 8 * table + at)[:, : max(1, own.axes[at] // 2)]
    return np.stack([turned, -turned], axis=2).reshape(len(x), -1)


def buckets(x: np.ndarray, own: Shape, table: int) -> np.ndarray:
    """The bucket of each direction."""
    code = np.zeros(len(x), np.int64)
    for at, axes in enumerate(own.axes):
        code = code * axes + _signed(x, own, table, at).argmax(axis=1)
    return code


def probes(x: np.ndarray, own: Shape, table: int) -> np.ndarray:
    """The buckets that lose least for each direction, own.probes of them: (rows, probes), ascending codes."""
    code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for at, axes in enumerate(own.axes):
        reach = _signed(x, own, table, at)
        extra = (reach.max(axis=1, keepdims=True) - reach) ** 2
        code = (code[:, :, None] * axes + np.arange(axes)).reshape(len(x), -1)
        loss = (loss[:, :, None] + extra[:, None, :]).reshape(len(x), -1)
        if loss.shape[1] > own.probes:
            least = np.argpartition(loss, own.probes - 1, axis=1)[:, : own.probes]
            code, loss = np.take_along_axis(code, least, 1), np.take_along_axis(loss, least, 1)
    return np.sort(code, axis=1)


def _packed(vectors: DataFrame) -> DataFrame:
    """(vkey, asks, length, band, vector): components as one binary value of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            values = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), "<f8")
            sizes = np.diff(np.asarray(rows.offsets.to_numpy(), np.int64))
            ends = np.cumsum(sizes)
            band = np.zeros(len(batch), np.int32)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                band[at] = bands(values[(ends[at] - size)[:, None] + np.arange(size)])
            data = values.tobytes()
            packed = [data[8 * (b - n) : 8 * b] for b, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes.astype(np.int32)), pa.array(band), pa.array(packed, pa.binary())],
                names=["vkey", "asks", "length", "band", "vector"],
            )

    return vectors.mapInArrow(tidy(run), "vkey bigint, asks boolean, length int, band int, vector binary")


def _placed(vectors: DataFrame, shapes: dict[tuple[int, int], Shape], tables: int) -> DataFrame:
    """Rows for each group that a vector is in, and for each that a query goes to, with its buckets there."""
    kinds = {"length": pa.int32(), "band": pa.int32(), "table": pa.int32(), "coarse": pa.int64(), "asks": pa.bool_(), "vkey": pa.int64(), "vector": pa.binary(), "fine": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, own_bands = (np.asarray(batch.column(i).to_numpy()) for i in (2, 3))
            asks = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for size in np.unique(lengths).tolist():
                of_size = np.flatnonzero(lengths == size)
                for start in range(0, len(of_size), CHUNK):
                    at = of_size[start : start + CHUNK]
                    x = directions(np.frombuffer(b"".join(batch.column(4).take(pa.array(at)).to_pylist()), "<f8").reshape(-1, size))
                    for band in np.unique(own_bands[at]).tolist():
                        mine = own_bands[at] == band
                        own = shapes[size, band]
                        for table in range(tables if own.axes else 1):
                            code = buckets(x[mine], own, table)
                            yield out(batch, at[mine], size, band, table, own.coarse(code), False, [c.tobytes() for c in code.astype("<i8")])
                    asking = asks[at]
                    if not asking.any():
                        continue
                    for (length, band), own in shapes.items():
                        for table in range(tables if own.axes else 1) if length == size else ():
                            found = probes(x[asking], own, table)
                            coarse = own.coarse(found)
                            cuts = np.flatnonzero(np.c_[np.ones(len(found), bool), coarse[:, 1:] != coarse[:, :-1]])
                            flat = found.reshape(-1).astype("<i8")
                            fine = [flat[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), flat.size])]
                            yield out(batch, at[asking][cuts // found.shape[1]], size, band, table, coarse.reshape(-1)[cuts], True, fine)

    def out(batch, rows, size, band, table, coarse, asks, fine) -> pa.RecordBatch:
        n, take = len(rows), pa.array(rows)
        same = [pa.array(np.full(n, v), t) for v, t in ((size, pa.int32()), (band, pa.int32()), (table, pa.int32()))]
        columns = [*same, pa.array(coarse, pa.int64()), pa.array(np.full(n, asks)), batch.column(0).take(take), batch.column(4).take(take), pa.array(fine, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return vectors.mapInArrow(tidy(run), "length int, band int, table int, coarse bigint, asks boolean, vkey bigint, vector binary, fine binary")


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The TOP + 1 best different keys of each query."""
    order = np.lexsort((key, -score, query))
    query, key, score = query[order], key[order], score[order]
    # A pair has one score wherever it was met, so its repeats follow each other.
    fresh = np.r_[True, (query[1:] != query[:-1]) | (key[1:] != key[:-1])][: len(query)]
    query, key, score = query[fresh], key[fresh], score[fresh]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    kept = rank <= TOP
    return query[kept], key[kept], score[kept]


def _met(asks: np.ndarray, key: np.ndarray, vectors: list[bytes], fine: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Exact inner products of a group's queries with the candidates of their buckets: (query, vkey, score)."""
    at = np.flatnonzero(~asks)
    if not len(at) or len(at) == len(asks):
        return
    of = np.frombuffer(b"".join([fine[i] for i in at.tolist()]), "<i8")
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order]
    candidates = np.frombuffer(b"".join([vectors[i] for i in at.tolist()]), "<f8").reshape(-1, length)
    names = key[at]
    for i in np.flatnonzero(asks).tolist():
        looked = np.frombuffer(fine[i], "<i8")
        low, high = np.searchsorted(of, looked, "left"), np.searchsorted(of, looked, "right")
        n = high - low
        if not n.any():
            continue
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own = np.frombuffer(vectors[i], "<f8")
        for start in range(0, len(hit), PAIRS):
            some = hit[start : start + PAIRS]
            score = np.einsum("ij,j->i", candidates[some], own)
            if len(score) > 4 * TOP:
                least = np.partition(score, len(score) - TOP - 1)[len(score) - TOP - 1]
                some, score = some[score >= least], score[score >= least]
            yield np.full(len(some), key[i]), names[some], score


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of each query within this partition; the rows of a group follow each other."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, group, rows = 0, None, []

    def keep() -> None:
        nonlocal held
        if found:
            found[:] = [_best(*(np.concatenate(x) for x in zip(*found)))]
            held = len(found[0][0])

    def flush() -> None:
        nonlocal held
        if rows:
            asks, key = (np.concatenate(x) for x in list(zip(*rows))[:2])
            vectors, fine = ([v for row in rows for v in row[i]] for i in (2, 3))
            for hit in _met(asks, key, vectors, fine, group[0]):
                found.append(hit)
                held += len(hit[0])
                if held > HELD:
                    keep()
            rows.clear()

    for batch in batches:
        places = np.stack([np.asarray(batch.column(i).to_numpy(), np.int64) for i in range(6)], axis=1)
        cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if tuple(places[a].tolist()) != group:
                flush()
                group = tuple(places[a].tolist())
            part = batch.slice(a, b - a)
            rows.append((np.asarray(part.column(6).to_numpy(zero_copy_only=False), bool), np.asarray(part.column(7).to_numpy()), part.column(8).to_pylist(), part.column(9).to_pylist()))
    flush()
    keep()
    for query, key, score in found:
        for start in range(0, len(query), 50_000):
            cut = slice(start, start + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(query[cut], pa.int64()), pa.array(key[cut], pa.int64()), pa.array(score[cut])], names=["query", "vkey", "score"])


def _compared(placed: DataFrame, most: int) -> DataFrame:
    """(query, vkey, score): the best of what each query meets at its places."""
    count = lambda asks: F.count_if(F.col("asks") == asks)
    counts = placed.groupBy(*PLACE).agg(F.ceil(count(False) / CANDIDATES).alias("_cs"), F.ceil(count(True) / QUERIES).alias("_qs"))
    large = materialize(counts.where("_cs > 1 OR _qs > 1"), "groups")
    part = lambda n: F.array(F.pmod(F.xxhash64("vkey"), n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    parts = placed.join(large, PLACE, "left").withColumns({"_cs": F.greatest(F.lit(1), F.coalesce("_cs", F.lit(1))), "_qs": F.greatest(F.lit(1), F.coalesce("_qs", F.lit(1)))})
    cs, qs = F.col("_cs").cast("long"), F.col("_qs").cast("long")
    parts = parts.withColumn("_ci", F.explode(F.when(F.col("asks"), every(cs)).otherwise(part(cs))))
    parts = parts.withColumn("_qi", F.explode(F.when(F.col("asks"), part(qs)).otherwise(every(qs))))
    keys = [*PLACE, "_ci", "_qi"]
    sorted_parts = parts.select(*keys, "asks", "vkey", "vector", "fine").repartition(*keys).sortWithinPartitions(*keys)
    ranked = sorted_parts.mapInArrow(tidy(_rank), "query bigint, vkey bigint, score double")
    by_query = Window.partitionBy("query").orderBy(F.col("score").desc(), "vkey")
    best = ranked.groupBy("query", "vkey").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(by_query))
    return best.where(F.col("_n") <= most).select("query", "vkey", "score")


def nearest(
    rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, tables: int = TABLES, probes_share: float = PROBES
) -> DataFrame:
    """(query_id, rank, <id>, score): each query's nearest rows but itself, nearest first. ``top``: TOP at most."""
    if top > TOP:
        raise ValueError(f"top is {TOP} at most")
    given = rows.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), F.col(vector_col).cast("array<double>").alias("vector"))
    given = given.where(usable(F.col("vector")) & F.col("id").isNotNull()).withColumn("asks", F.coalesce("asks", F.lit(False)))
    # -0.0 and 0.0 are one number.
    given = given.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).distinct()
    distinct = materialize(given.groupBy("vector").agg(F.min("id").alias("vkey"), F.bool_or("asks").alias("asks")), "vectors")
    packed = materialize(_packed(distinct.select("vkey", "asks", "vector")), "packed")
    # One row for each length and band of norms.
    sizes = packed.groupBy("length", "band").agg(F.count(F.lit(1)).alias("n")).collect()
    shapes = {(r["length"], r["band"]): shape(r["n"], r["length"], probes_share) for r in sizes}
    placed = materialize(_placed(packed, shapes, tables), "placed")
    best = materialize(_compared(placed, top + 1), "best")
    # Queries that met too few meet all.
    met = best.groupBy("query").agg(F.count(F.lit(1)).alias("_met"))
    all_of = packed.groupBy("length").agg(F.count(F.lit(1)).alias("_all"))
    short = packed.where("asks").join(met, F.col("vkey") == F.col("query"), "left").join(all_of, "length")
    short = materialize(short.where(F.coalesce("_met", F.lit(0)) < F.least(F.lit(top + 1), "_all")).select("vkey", "length", "vector"), "short")
    if not short.isEmpty():
        zero = F.lit(0).cast("long")
        whole = lambda df, asks: df.select("length", F.lit(0).alias("band"), F.lit(0).alias("table"), zero.alias("coarse"), F.lit(asks).alias("asks"), "vkey", "vector", F.unhex(F.lit("00" * 8)).alias("fine"))
        rest = _compared(whole(packed, False).unionByName(whole(short, True)), top + 1)
        best = best.join(short.select(F.col("vkey").alias("query")), "query", "left_anti").unionByName(rest)
    # Back from vectors to rows: the smallest ids of each found vector, and all the queries that have the asking one.
    by_vector = Window.partitionBy("vector").orderBy("id")
    smallest = given.select("vector", "id").distinct().withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= top + 1)
    members = smallest.join(distinct.select("vector", "vkey"), "vector").select("vkey", "id")
    hits = best.join(members, "vkey")
    per_vector = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    hits = hits.withColumn("_n", F.row_number().over(per_vector)).where(F.col("_n") <= top + 1).select("query", "id", "score")
    queries = given.where("asks").select("vector", F.col("id").alias("query_id")).join(distinct.select("vector", F.col("vkey").alias("query")), "vector")
    pairs = queries.select("query", "query_id").join(hits, "query").where(F.col("id") != F.col("query_id"))
    per_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(id_col), "score")
