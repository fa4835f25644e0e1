"""N-gram Jaccard join by vertical partitioning.

Words are what lies between ASCII white space, A-Z lower-cased; a document's set is its distinct five-word
shingles (64-bit hashes of the words' bytes). The global order of shingles is by how common they are, so that rare ones
come first: those of LEAST sets or more by their counts, which are exact but for 36 bits of the hash, the others by the
logarithm of a counting sketch over all documents; then by hash. A sketch alone can't tell shingles of some dozen sets once its
cells hold hundreds. Fragments cut the order of the sketch into about equal numbers of occurrences.

1. Equal sets are one class from here on; copies are never paired with each other.
2. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of both. These prefixes are cut by
   fragment, and each fragment pairs the classes that share one of its shingles and whose sizes allow a link, with
   the number that they share. Summed per pair, these partial overlaps rule out pairs that share too little so far.
   A shingle of up to RUN classes gives all its pairs; one of more gives stars, every class with HUBS of them.
3. Classes of candidate pairs are cut vertically into VERTICAL fragments of the whole order. Each fragment counts the
   partial overlap of every pair on its own, and the parts are summed per pair. What belongs together for that is
   a cluster of candidate pairs, cut by the hashes of both classes of a pair into blocks of bounded size.
4. Links join into components. Stars lose no link that would join more: of the classes that crowded shingles connect,
   those outside the largest component are held against the others in blocks of bounded size. If two sets share no
   shingle that gave all its pairs, what they share is crowded or lies behind a prefix; that bounds their overlap, so
   that a class with many rare shingles (boilerplate around a text of its own) meets hardly any block.

Defined cases: a null text, and a text without words, has an empty set and is linked with nothing; with fewer than
five words the whole sequence is one shingle; equal rows are copies; rows with a null id take part in nothing and
come back with a null component; an empty table gives an empty result; columns other than id and text are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import materialize, salted_join, tidy, utf8_parts
from traceloom.llm.components import components
from traceloom.llm.hashing import Hashes, chain, id_map, in_map, mix
from traceloom.scratch import free_shuffles, scratch_tables

WIDTH = 5
#: Similarity as a fraction, compared in integers.
OVER, OF = 75, 100
#: Cells of the counting sketch that orders shingles (2^bits counters).
SKETCH_BITS = 22
#: Bits by which shingles are counted; sets from which on a shingle is listed with its count, and how many are listed at most
#: (the most common ones: the list only orders).
COUNT_BITS, LEAST, LISTED = 36, 4, 1 << 21
#: Shingles of a task that are sorted and cut at a time to be counted; about so many bytes are counted by a task.
COUNTED, COUNT_BYTES = 1 << 21, 12 << 20
#: Classes of one shingle that are all paired at once.
RUN = 24
#: Classes of a shingle of more that are paired with all of its classes.
HUBS = 4
#: Vertical fragments in which overlaps are counted.
VERTICAL = 4
#: Classes, and shingles, of one block.
BLOCK, BLOCK_SHINGLES = 2_000, 1 << 21
#: Times as many classes may ask one block.
ASKS = 8
#: Sizes of one block are at most this apart, as a factor.
SIZES = 1.1
#: Blocks in which the counting sketch is added up, and how many sketches there are to add (more on more cores).
SKETCH_BLOCKS, SKETCHES = 1_024, 64
#: Bytes of prefix entries for each fragment, about.
FRAGMENT_BYTES = 8 << 20
#: Prefix entries of a task that are cut by fragment at a time.
ENTRIES = 1 << 19
#: Fragments for each task.
EACH = 4
#: Bits of the map of documents that are in a candidate pair.
MAP_BITS = 25
PAIRS = "a bigint, b bigint, size_a bigint, size_b bigint, shared bigint, star bigint, shingle bigint, classes binary"
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    rows = len(offsets) - 1
    if not len(data):
        return [np.empty(0, np.uint64)] * rows
    hashes = Hashes(_LOWER[data])
    space = _SPACE[data]
    starts = ~space
    follows = np.empty(len(data), bool)
    follows[0], follows[1:] = False, ~space[:-1]
    at_row = np.zeros(len(data) + 1, bool)
    at_row[offsets] = True
    follows &= ~at_row[:-1]
    starts = np.flatnonzero(~space & ~follows)
    ends = np.flatnonzero(~space & np.r_[space[1:] | at_row[1:-1], True]) + 1
    words = hashes.of(starts, ends)
    bounds = np.searchsorted(starts, offsets)
    if len(words) >= WIDTH:
        grams = chain(words, WIDTH)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WIDTH:
            found.append(np.unique(grams[a : b - WIDTH + 1]))
        elif b > a:
            digest = hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest()
            found.append(np.frombuffer(digest, np.uint64).copy())
        else:
            found.append(np.empty(0, np.uint64))
    return found


def digest_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest()


def class_of(own: np.ndarray) -> int:
    """A set's class: the leading half of its digest."""
    return int.from_bytes(digest_of(own)[:8], "little", signed=True)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with their texts' shingle sets; about SLICE bytes each, or one long text."""
    data, offsets = utf8_parts(batch.column(column))
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
        part = offsets[start : stop + 1]
        yield batch.slice(start, stop - start), shingle_sets(data[part[0] : part[-1]], part - part[0])
        start = stop


def prefix_length(size: int) -> int:
    """Of two sets that link, both have a shared shingle among their first so many."""
    return size - (OVER * size + OF - 1) // OF + 1 if size else 0


class Order:
    """The global order of shingles: by their rank (``listed`` shingles and their levels, then the sketch's), then by hash."""

    def __init__(self, levels: np.ndarray, mass: np.ndarray):
        self.levels, self.total = levels, int(mass.sum())
        self.listed, self.common = np.empty(0, np.uint64), np.empty(0, np.int16)
        share = mass / max(1, self.total)
        self.start, self.share = np.cumsum(share) - share, share

    def level(self, shingles: np.ndarray) -> np.ndarray:
        return self.levels[(shingles >> _U(64 - SKETCH_BITS)).astype(np.int64)]

    def rank(self, shingles: np.ndarray) -> np.ndarray:
        level = self.level(shingles).astype(np.int16)
        if len(self.listed):
            keys = shingles >> _U(64 - COUNT_BITS)
            at = np.minimum(np.searchsorted(self.listed, keys), len(self.listed) - 1)
            level += np.where(self.listed[at] == keys, self.common[at] * 64, 0).astype(np.int16)
        return level

    def fragment(self, shingles: np.ndarray, fragments: int) -> np.ndarray:
        """Which of so many cuts of the order, of about equal numbers of occurrences, a shingle lies in."""
        level = self.level(shingles)
        # Cells take the leading bits, so places within a level go by the following ones, which any cell has alike.
        within = ((shingles << _U(SKETCH_BITS)) >> _U(32)).astype(np.float64) / 2**32
        place = self.start[level] + self.share[level] * within
        return np.minimum((place * fragments).astype(np.int64), fragments - 1)


def counted(source: DataFrame) -> DataFrame:
    """A row for each document (class digest, set size), and each task's counts of the sketch cells, by blocks.

    Tasks are few, as each has a whole sketch of its own: what they write does not grow with the input."""
    blocks, width = SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS
    names = ["_id", "digest", "class", "size", "block", "cells"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, id_type = np.zeros(1 << SKETCH_BITS, np.int32), None
        for batch in batches:
            id_type = batch.column(0).type
            for part, sets in slices(batch, 1):
                own, times = np.unique((np.concatenate(sets) >> _U(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
                cells[own] += times.astype(np.int32)
                digests = [digest_of(own) if len(own) else None for own in sets]
                classes = [int.from_bytes(d[:8], "little", signed=True) if d else None for d in digests]
                sizes = pa.array([len(own) for own in sets], pa.int64())
                n = len(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(classes, pa.int64()), sizes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        parts = np.minimum(cells, 65_535).astype("<u2").reshape(blocks, width)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            n = len(used)
            none = [pa.nulls(n, id_type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=names)

    kind = source.schema[0].dataType.simpleString()
    tasks = max(SKETCHES, 2 * source.sparkSession.sparkContext.defaultParallelism)
    return source.coalesce(tasks).mapInArrow(tidy(count), f"_id {kind}, digest binary, class bigint, size bigint, block int, cells binary")


def sketch(cells: DataFrame) -> Order:
    """Levels of all sketch cells (logarithms of their counts), and how many occurrences each level has."""
    blocks, width = SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(cells, "<u2").astype(np.int64)
        levels = [np.floor(np.log2(x + 1)).astype(np.uint8) for x in sums.values()]
        mass = [np.bincount(level, x, 64).astype("<i8").tobytes() for level, x in zip(levels, sums.values())]
        out = [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in levels], pa.binary()), pa.array(mass, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["block", "levels", "mass"])

    levels, mass = np.zeros((blocks, width), np.uint8), np.zeros(64, np.int64)
    for row in cells.select("block", "cells").repartition("block").mapInArrow(tidy(add), "block int, levels binary, mass binary").collect():
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
        mass += np.frombuffer(row["mass"], "<i8")
    return Order(levels.reshape(-1), mass)


def list_common(source: DataFrame, reps: DataFrame, order: Order) -> None:
    """Give the order the shingles of LEAST classes or more, with levels by their counts.

    Sorted shingles go by ranges of their leading bits, as byte planes of the gaps between them (two or three bytes each)."""
    width = 1 << COUNT_BITS
    tasks = max(16, math.ceil(order.total * 3 / COUNT_BYTES))
    parts = EACH * tasks
    slot = F.pmod(F.xxhash64("_id"), F.lit(1 << MAP_BITS))
    wanted = id_map(reps.select(F.col("rep").alias("_id")).select(slot.alias("slot")).distinct(), MAP_BITS)

    def rows_of(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(sets) >> _U(64 - COUNT_BITS)).astype(np.int64)
        cuts = np.searchsorted(keys, np.arange(parts + 1) * width // parts)
        found = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
        blobs = [np.diff(keys[cuts[k] : cuts[k + 1]], prepend=k * width // parts).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for k in found]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "gaps"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held, seen = [], 0, set()
        for batch in batches:
            at = np.asarray(batch.column(1))
            batch = batch.filter(pa.array(((wanted.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)))
            for _, sets in slices(batch, 0):
                if len(seen) > 200_000:
                    seen.clear()
                for own in sets:
                    if len(own) and (name := class_of(own)) not in seen:
                        seen.add(name)
                        gathered.append(own)
                        held += len(own)
                if held >= COUNTED:
                    yield rows_of(gathered)
                    gathered, held = [], 0
        if gathered:
            yield rows_of(gathered)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, gaps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blobs.setdefault(part, []).append(gaps)
        for part in list(blobs):
            every = [np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1) for x in blobs.pop(part)]
            keys = np.sort(np.concatenate([np.cumsum(x, dtype=np.int64) for x in every])) + part * width // parts
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            times = np.diff(np.r_[starts, len(keys)])
            keys, times = keys[starts[times >= LEAST]], times[times >= LEAST]
            level = np.floor(4 * np.log2(times)).astype(np.int32)
            for own in np.unique(level).tolist():
                mine = keys[level == own]
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([len(mine)], pa.int64()), pa.array([mine.astype("<i8").tobytes()], pa.binary())], names=["level", "n", "keys"])

    gaps = source.select("_text", slot.alias("slot")).mapInArrow(tidy(cut), "part int, gaps binary").repartition(tasks, "part")
    found = materialize(gaps.mapInArrow(tidy(count), "level int, n bigint, keys binary"), "common")
    held, least = 0, 0
    for row in found.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        held += row["n"]
        if held > LISTED:
            least = row["level"] + 1
            break
    rows = [(np.frombuffer(row["keys"], "<i8"), row["level"]) for row in found.where(F.col("level") >= least).select("level", "keys").toLocalIterator()]
    if rows:
        keys = np.concatenate([own for own, _ in rows]).astype(np.uint64)
        by = np.argsort(keys)
        order.listed, order.common = keys[by], np.repeat([level for _, level in rows], [len(own) for own, _ in rows])[by].astype(np.int16)


def _prefixes(source: DataFrame, order, fragments: int) -> DataFrame:
    """Prefix entries in rows for each fragment.

    A row holds, for the classes of some slices: how many entries each has, their ids and sizes, and the entries. Slices
    are gathered until there are ENTRIES, so that rows stay long when the input has many fragments."""

    def rows_of(hashes: list[np.ndarray], owners: list[int], lengths: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(owners)), [len(h) for h in hashes])
        where = order.value.fragment(flat, fragments)
        by = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[by], np.arange(fragments + 1))
        names, sizes = np.array(owners, np.int64), np.array(lengths, np.int64)
        rows, blobs = [], []
        for f in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            pick = by[cuts[f] : cuts[f + 1]]
            used, local = np.unique(owner[pick], return_inverse=True)
            head = np.array([len(used), len(pick)], "<i8").tobytes()
            blobs.append(head + names[used].tobytes() + sizes[used].astype("<i4").tobytes() + local.astype("<i4").tobytes() + flat[pick].astype("<u8").tobytes())
            rows.append(f)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["fragment", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), 0
        hashes, owners, lengths = [], [], []
        for batch in batches:
            for _, sets in slices(batch, 1):
                if len(seen) > 200_000:
                    seen.clear()
                for own in sets:
                    if not len(own) or (name := class_of(own)) in seen:
                        continue
                    seen.add(name)
                    size, keep = len(own), prefix_length(len(own))
                    if keep < size:
                        own = own[np.argsort(order.value.rank(own), kind="stable")[:keep]]
                    hashes.append(own)
                    owners.append(name)
                    lengths.append(size)
                    held += len(own)
                if held >= ENTRIES:
                    yield rows_of(hashes, owners, lengths)
                    hashes, owners, lengths, held = [], [], [], 0
        if hashes:
            yield rows_of(hashes, owners, lengths)

    return source.mapInArrow(tidy(run), "fragment int, entries binary")


def _pairs_of_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the fragments in this partition, and the classes of each shingle with more than RUN."""
    hashes, names, sizes = [], [], []
    for batch in batches:
        for blob in batch.column(batch.schema.get_field_index("entries")).to_pylist():
            used, count = np.frombuffer(blob, "<i8", 2)
            at = 16
            own = np.frombuffer(blob, "<i8", used, at)
            size = np.frombuffer(blob, "<i4", used, at := at + 8 * used)
            local = np.frombuffer(blob, "<i4", count, at := at + 4 * used)
            hashes.append(np.frombuffer(blob, "<u8", count, at + 4 * count))
            names.append(own[local])
            sizes.append(size[local])
    if not hashes:
        return
    hashes, names, sizes = np.concatenate(hashes), np.concatenate(names), np.concatenate(sizes).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    # Only shingles with company matter from here on.
    same = hashes[1:] == hashes[:-1]
    company = np.r_[same, False] | np.r_[False, same]
    hashes, order = hashes[company], order[company]
    names, sizes = names[order], sizes[order]
    order = np.lexsort((names, hashes))
    hashes, names, sizes = hashes[order], names[order], sizes[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (names[1:] != names[:-1])][: len(hashes)]
    hashes, names, sizes = hashes[fresh], names[fresh], sizes[fresh]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    lengths = np.diff(np.r_[starts, len(hashes)])
    found = []

    def keep(i: np.ndarray, j: np.ndarray, star: int) -> None:
        fit = OF * np.minimum(sizes[i], sizes[j]) >= OVER * np.maximum(sizes[i], sizes[j])
        i, j = i[fit], j[fit]
        swap = names[i] > names[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        found.append(np.stack([names[i], names[j], sizes[i], sizes[j], np.full(len(i), star)]))

    for n in np.unique(lengths[(lengths > 1) & (lengths <= RUN)]).tolist():
        first = starts[lengths == n]
        for gap in range(1, n):
            left = (first[:, None] + np.arange(n - gap)).reshape(-1)
            keep(left, left + gap, 0)
    crowded = []
    for a, n in zip(starts[lengths > RUN].tolist(), lengths[lengths > RUN].tolist()):
        members = np.arange(a, a + n)
        # Hubs by hashes of the classes, so that the shingles of one group of near copies mostly have the same ones.
        for hub in a + np.argsort(mix(names[members].view(np.uint64)))[:HUBS]:
            others = members[members != hub]
            keep(np.full(len(others), hub), others, 1)
        crowded.append((int(hashes[a].view(np.int64)), names[members].astype("<i8").tobytes()))
    kinds = {"a": pa.int64(), "b": pa.int64(), "size_a": pa.int64(), "size_b": pa.int64(), "shared": pa.int64(), "star": pa.int64(), "shingle": pa.int64(), "classes": pa.binary()}
    if found:
        a, b, size_a, size_b, star = np.concatenate(found, axis=1)
        found.clear()
        by = np.lexsort((b, a))
        a, b, size_a, size_b, star = a[by], b[by], size_a[by], size_b[by], star[by]
        cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        if len(cuts):
            shared, star = np.diff(np.r_[cuts, len(a)]), np.maximum.reduceat(star, cuts)
            n = len(cuts)
            columns = [pa.array(x, pa.int64()) for x in (a[cuts], b[cuts], size_a[cuts], size_b[cuts], shared, star)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=list(kinds))
    n = len(crowded)
    if n:
        columns = [pa.array([c[0] for c in crowded], pa.int64()), pa.array([c[1] for c in crowded], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(6)), *columns], names=list(kinds))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in batch.column(0).to_pylist():
            names = np.frombuffer(own, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), names.min())), pa.array(names)], names=["a", "b"])


def _crowded(candidates: DataFrame) -> DataFrame:
    """(a, b, n): classes b of crowded shingles, tied to the least class of each, and by how many shingles."""
    members = candidates.where("shingle IS NOT NULL").select("classes").mapInArrow(tidy(_members), "a bigint, b bigint")
    return members.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _possible(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs whose partial overlaps over all prefix fragments leave room for a link.

    Behind the end of the shorter-reaching prefix each set has at most size - prefix shingles, so the overlap is at
    most shared + the larger of these, and the crowded shingles that both may have. Pairs of stars pass."""
    summed = candidates.where("a IS NOT NULL").groupBy("a", "b").agg(
        F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("shared").alias("shared"), F.max("star").alias("star")
    )
    for side in ("a", "b"):
        summed = summed.join(held.select(F.col("node").alias(side), F.col("crowded").alias(f"crowded_{side}")), side, "left")
    behind = lambda size: F.ceil(size * OVER / OF) - 1  # noqa: E731  size - prefix_length(size)
    more = F.least(F.coalesce("crowded_a", F.lit(0)), F.coalesce("crowded_b", F.lit(0)))
    most = F.col("shared") + F.greatest(behind(F.col("size_a")), behind(F.col("size_b"))) + more
    return summed.where((F.col("star") == 1) | ((OF + OVER) * most >= OVER * (F.col("size_a") + F.col("size_b")))).select("a", "b")


def _overlaps(source: DataFrame, classes: DataFrame, pairs: DataFrame, order, label: str) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of candidate pairs, by vertical fragments."""
    cluster = components(pairs)
    large = cluster.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_cuts")).where("_cuts > 1")
    # A cluster of more than BLOCK classes is cut by the hashes of both classes, so that a hub's pairs part as well.
    of_pairs = salted_join(pairs.join(cluster.withColumnRenamed("node", "b"), "b"), large, "component", "a")
    part = lambda name: F.pmod(F.xxhash64(name), F.coalesce("_cuts", F.lit(1)))
    routed = of_pairs.select("a", "b", F.xxhash64("component", part("a"), part("b")).alias("key"))
    routed = materialize(routed, f"{label}-routes")
    # Each class goes to each of its keys once, with its partners there.
    route = (
        routed.groupBy(F.col("b").alias("class"), "key").agg(F.collect_set("a").alias("partners"))
        .unionByName(routed.select(F.col("a").alias("class"), "key").distinct().withColumn("partners", F.array().cast("array<bigint>")))
        .groupBy("class", "key").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    )
    route = materialize(route.join(classes.select("class", "rep"), "class"), f"{label}-route")
    slot = F.pmod(F.xxhash64("_id"), F.lit(1 << MAP_BITS))
    wanted = in_map(id_map(route.select(F.col("rep").alias("_id")).select(slot.alias("slot")).distinct(), MAP_BITS))
    texts = source.where(wanted(slot))
    joined = texts.join(route.withColumnRenamed("rep", "_id"), "_id").select("_text", "class", "key", "partners")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in slices(batch, 0):
                # An id that stands in several rows brings texts of other classes as well.
                fits = [i for i, (own, name) in enumerate(zip(sets, part.column(1).to_pylist())) if class_of(own) == name]
                part, sets = part.take(pa.array(fits, pa.int64())), [sets[i] for i in fits]
                wheres = [order.value.fragment(own, VERTICAL) for own in sets]
                segments = [own[where == v].astype("<u8").tobytes() for own, where in zip(sets, wheres) for v in range(VERTICAL)]
                at = np.repeat(np.arange(len(part)), VERTICAL)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).take(pa.array(at)), pa.array(np.tile(np.arange(VERTICAL), len(part)), pa.int32()), part.column(1).take(pa.array(at)), pa.array(segments, pa.binary()), part.column(3).take(pa.array(at))],
                    names=["key", "vertical", "class", "segment", "partners"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, out = None, {}, []

        def flush() -> None:
            for name, (segment, partners) in own.items():
                for other in set(partners):
                    if other in own:
                        out.append((other, name, len(np.intersect1d(own[other][0], segment, assume_unique=True))))

        def batch_of(rows):
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "part"])

        for batch in batches:
            for key, vertical, name, segment, partners in zip(*(column.to_pylist() for column in batch.columns)):
                if (key, vertical) != current:
                    flush()
                    current = (key, vertical)
                    own.clear()
                held = own.get(name)
                own[name] = (np.frombuffer(segment, "<u8"), [*(held[1] if held else ()), *partners])
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        flush()
        yield batch_of(out)

    segments = joined.mapInArrow(tidy(cut), "key bigint, vertical int, class bigint, segment binary, partners array<bigint>")
    parts = segments.repartition("key", "vertical").sortWithinPartitions("key", "vertical").mapInArrow(tidy(count), "a bigint, b bigint, part bigint")
    total = parts.groupBy("a", "b").agg(F.sum("part").alias("overlap"))
    size = classes.select("class", "size")
    return total.join(size.withColumnsRenamed({"class": "a", "size": "size_a"}), "a").join(size.withColumnsRenamed({"class": "b", "size": "size_b"}), "b")


def _linked(overlaps: DataFrame) -> DataFrame:
    return overlaps.where(OF * F.col("overlap") >= OVER * (F.col("size_a") + F.col("size_b") - F.col("overlap"))).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles and component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # What only one step needs is deleted after it, tables and shuffles alike. Prefix entries are the most by far; they
    # are shuffled as they are made, and written nowhere else.
    with scratch_tables(spark):
        found = materialize(counted(source), "counted")
        order = sketch(found.where("cells IS NOT NULL"))
        rows = materialize(found.where("cells IS NULL").select("_id", "digest", "class", "size"), "rows", keep=True)
    fragments = max(16, math.ceil(order.total * 3 / FRAGMENT_BYTES))
    classes = materialize(rows.where("class IS NOT NULL AND _id IS NOT NULL").groupBy("digest", "class", "size").agg(F.min("_id").alias("rep")), "classes")
    free_shuffles(spark)
    with scratch_tables(spark):
        list_common(source, classes, order)
    free_shuffles(spark)
    order = spark.sparkContext.broadcast(order)
    with scratch_tables(spark):
        # Fragments of the order are finer than tasks, which hashing evens out.
        entries = _prefixes(source, order, EACH * fragments).repartition(fragments, "fragment").select("entries")
        candidates = materialize(entries.mapInArrow(tidy(_pairs_of_fragment), PAIRS), "candidates")
        free_shuffles(spark)
        crowded = materialize(_crowded(candidates), "crowded", keep=True)
        held = materialize(crowded.groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("crowded")), "held", keep=True)
        pairs = materialize(_possible(candidates, held), "pairs", keep=True)
    free_shuffles(spark)
    with scratch_tables(spark):
        links = materialize(_linked(_overlaps(source, classes, pairs, order, "overlap")), "links", keep=True)
    free_shuffles(spark)
    with scratch_tables(spark):
        links = materialize(_complete(source, classes, crowded, held, links), "links", keep=True)
    free_shuffles(spark)
    # Components are named by ids: the smallest of any class in them.
    nodes = classes.select(F.col("class").alias("node"), "rep")
    joined = components(links)
    least = joined.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = salted_join(nodes.join(joined, "node", "left"), least, "component", "node").select(F.col("node").alias("class"), F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(of_class, "class", "left").select(
        F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _sets(source: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, set) of the classes in (node, rep), each computed once."""
    slot = F.pmod(F.xxhash64("_id"), F.lit(1 << MAP_BITS))
    reps = reps.withColumnRenamed("rep", "_id")
    wanted = in_map(id_map(reps.select(slot.alias("slot")).distinct(), MAP_BITS))
    joined = source.where(wanted(slot)).join(reps, "_id").select("_text", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in slices(batch, 0):
                fits = [(name, own.astype("<u8").tobytes()) for own, name in zip(sets, part.column(1).to_pylist()) if class_of(own) == name]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in fits], t) for i, t in ((0, pa.int64()), (1, pa.binary()))], names=["node", "set"])

    return joined.mapInArrow(tidy(run), "node bigint, set binary").dropDuplicates(["node"])


def _complete(source: DataFrame, classes: DataFrame, crowded: DataFrame, held: DataFrame, links: DataFrame) -> DataFrame:
    """Links between classes of one crowded shingle that the stars left in different components.

    Classes that crowded shingles connect are a family. Most of a family is one component by now; classes outside it
    are held against the blocks of their family whose sizes and reach allow a link: an inverted index of a block's
    shingles counts the overlaps with all its classes at once, and of each component that a class links to, one link
    is handed on. The reach of a class is the largest set that it could link to by crowded shingles of its prefix and
    by what lies behind it alone; of two sets that share no other shingle, at least one has the other in its reach."""

    if crowded.isEmpty():
        return links
    family = components(crowded).withColumnRenamed("component", "family")
    placed = family.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")).join(held, "node")
    placed = placed.join(classes.select(F.col("class").alias("node"), "rep", "size"), "node")
    most = F.ceil(F.col("size") * OVER / OF) - 1 + F.col("crowded")
    placed = placed.withColumn("reach", F.floor(F.least("size", most) * (OF + OVER) / OVER) - F.col("size"))
    placed = placed.withColumn("strong", OF * F.col("reach") >= OVER * F.col("size")).withColumn("sizes", F.floor(F.log("size") / math.log(SIZES)))
    placed = materialize(placed.drop("crowded"), "placed")
    counts = placed.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    of = materialize(salted_join(placed, per, "family", "node", "inner").withColumn("asks", F.col("component") != F.col("main")).drop("main", "parts"), "asking")
    kind = ["family", "strong", "sizes"]
    groups = of.groupBy(*kind).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"),
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("reach").alias("far"),
    )
    groups = materialize(groups, "groups")
    asking = salted_join(of.where("asks").drop("strong", "sizes"), groups, "family", "node", "inner")
    asking = asking.where((OF * F.col("high") >= OVER * F.col("size")) & (OF * F.col("size") >= OVER * F.col("low")))
    asking = asking.where((F.col("low") <= F.col("reach")) | (F.col("size") <= F.col("far")))
    asking = asking.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*kind, "_block", "node", "component")
    asking = materialize(asking, "asks")
    if asking.isEmpty():
        return links
    # The asking classes of a block are cut as well; the block's own go to each part.
    parts = asking.groupBy(*kind, "_block").agg(F.ceil(F.count(F.lit(1)) / (ASKS * BLOCK)).alias("_parts"))
    parts = materialize(parts, "parts")
    asking = asking.join(parts, [*kind, "_block"]).withColumn("_part", F.pmod(F.xxhash64("node"), F.col("_parts"))).withColumn("asks", F.lit(True))
    own = of.join(groups.select(*kind, "blocks"), kind).withColumn("_block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    own = own.join(parts, [*kind, "_block"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).withColumn("asks", F.lit(False))
    columns = ["node", "component", "asks", F.xxhash64(*kind, "_block", "_part").alias("key")]
    route = materialize(own.select(*columns).unionByName(asking.select(*columns)), "blocks")
    reps = route.select("node").distinct().join(classes.select(F.col("class").alias("node"), "rep"), "node")
    sets = materialize(_sets(source, materialize(reps, "reps")), "sets")
    blocks = route.join(sets, "node").select("key", "node", "component", "asks", "set").repartition("key").sortWithinPartitions("key", "asks", "node")
    return links.union(blocks.mapInArrow(tidy(_scan_blocks), "a bigint, b bigint"))


def _scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the asking classes of each block (its rows follow each other, asking ones last)."""
    current, out, index = None, [], None
    names, parts, sets = [], [], []

    def batch_of(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])

    def indexed() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(own) for own in sets])
        shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
        sets.clear()
        order = np.argsort(shingles, kind="stable")
        return size, shingles[order], owner[order], np.array(parts)

    def ask(name: int, component: int, own: np.ndarray) -> None:
        size, shingles, owner, part = index
        low, high = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        overlap = np.bincount(owner[at], minlength=len(size))
        found = np.flatnonzero((OF * overlap >= OVER * (size + len(own) - overlap)) & (part != component))
        _, first = np.unique(part[found], return_index=True)
        out.extend((name, names[i]) for i in found[first].tolist())

    for batch in batches:
        for key, name, component, asks, own in zip(*(column.to_pylist() for column in batch.columns)):
            if key != current:
                current, index = key, None
                names, parts, sets = [], [], []
            own = np.frombuffer(own, "<u8")
            if not asks:
                names.append(name), parts.append(component), sets.append(own)
            elif names:
                index = index or indexed()
                ask(name, component, own)
        if len(out) > 10_000:
            yield batch_of(out)
            out.clear()
    yield batch_of(out)
