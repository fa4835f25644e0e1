"""Exact deduplication with counting quotient filters.

Each partition of the corpus builds a counting quotient filter: the 64-bit fingerprints of its texts are
split into a quotient (the leading bits, which name a slot run) and a remainder, and every run holds its
remainders in ascending order with a counter. Runs are cut into blocks of neighbouring quotients, shuffled
by block and merged by their sorted remainders, which loses nothing: counters of equal remainders add up.
Fingerprints whose counter exceeds one route their texts to the byte verification, a grouping by the whole
normalised text with partial aggregation, so that a hot group of copies shrinks to one row per task before
it is shuffled. Texts whose quotient no repeated fingerprint occupies never leave their partition. Rows of groups
of more than HOT copies meet their group's row in parts, dealt out by id. Quotients and blocks follow from the number
of rows.

Defined cases: a null text equals the empty text; rows with a null id take part and never stay for others;
rows that repeat id and text count as one document listed twice (all of them carry the keeper's id and are
marked as kept; where rows are taken out, one of them stays); an empty table gives an empty result; columns of the input other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from traceloom.llm.common import SPACES, materialize, tidy

#: Leading bits of a fingerprint that are its quotient, at least and at most; about 8 quotients for each row between
#: these. The map of repeated quotients takes 2^(bits - 3) bytes, 256 MB at most; beyond it more texts are verified.
QUOTIENT_BITS = (20, 31)
#: Leading bits that name a block, the unit in which filters are merged, at least; about BLOCK_ROWS rows a block.
BLOCK_BITS, BLOCK_ROWS = 8, 1 << 18
#: Copies from which a group is dealt out, and into how many parts.
HOT, PARTS = 10_000, 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sizes_for(rows: int) -> tuple[int, int]:
    """Bits of quotients and of blocks for so many fingerprints."""
    quotient = min(QUOTIENT_BITS[1], max(QUOTIENT_BITS[0], rows.bit_length() + 3))
    return quotient, min(quotient - 6, max(BLOCK_BITS, (rows // BLOCK_ROWS).bit_length()))


def pack(prints: np.ndarray, counts: np.ndarray, quotient_bits: int, block_bits: int) -> dict[int, tuple[bytes, ...]]:
    """Ascending fingerprints as blocks of a counting quotient filter: which quotients have a run, where runs end among
    the slots, the slots' remainders at their real width, which slots count more than one, and these counters."""
    block = (prints >> np.uint64(64 - block_bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(prints)])
    width, out = 64 - quotient_bits, {}
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(prints)]):
        own, times = prints[a:b], counts[a:b]
        quotient = (own >> np.uint64(width)).astype(np.int64) & ((1 << (quotient_bits - block_bits)) - 1)
        occupied = np.zeros(1 << (quotient_bits - block_bits), bool)
        occupied[quotient] = True
        ends = np.r_[quotient[1:] != quotient[:-1], True]
        bits = ((own[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        more = times > 1
        out[int(block[a])] = (
            np.array([b - a], "<i8").tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(bits).tobytes(),
            np.packbits(more).tobytes(), times[more].astype("<i8").tobytes(),
        )
    return out


def unpack(block: int, parts: list[bytes], quotient_bits: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a block, ascending, and their counters."""
    slots, occupied, ends, bits, more, times = parts
    n, width = int(np.frombuffer(slots, "<i8")[0]), 64 - quotient_bits
    runs = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8), count=1 << (quotient_bits - block_bits)))
    ends = np.unpackbits(np.frombuffer(ends, np.uint8), count=n).astype(np.int64)
    quotient = runs[np.cumsum(ends) - ends].astype(np.uint64) | np.uint64(block << (quotient_bits - block_bits))
    rows = np.unpackbits(np.frombuffer(bits, np.uint8), count=n * width).reshape(n, width)
    remainder = np.zeros(n, np.uint64)
    for column in rows.T:
        remainder = (remainder << np.uint64(1)) | column
    counts = np.ones(n, np.int64)
    counts[np.unpackbits(np.frombuffer(more, np.uint8), count=n).astype(bool)] = np.frombuffer(times, "<i8")
    return (quotient << np.uint64(width)) | remainder, counts


_FILTER = "block int, parts array<binary>"


def merged_filter(prints: DataFrame, quotient_bits: int, block_bits: int) -> DataFrame:
    """The corpus' counting quotient filter from a column of fingerprints: (block, parts)."""

    def rows(prints: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block, parts in pack(prints, counts, quotient_bits, block_bits).items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([list(parts)], pa.list_(pa.binary()))], names=["block", "parts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64) for batch in batches]
        yield from rows(*np.unique(np.concatenate(own or [np.empty(0, np.int64)]).view(np.uint64), return_counts=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks follow each other; counters of equal remainders add up."""
        current, found = None, []

        def whole() -> Iterator[pa.RecordBatch]:
            if found:
                prints, counts = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(prints, kind="stable")
                prints = prints[order]
                starts = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
                yield from rows(prints[starts], np.add.reduceat(counts[order], starts))
                found.clear()

        for batch in batches:
            for block, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != current:
                    yield from whole()
                    current = block
                found.append(unpack(block, parts, quotient_bits, block_bits))
        yield from whole()

    built = prints.mapInArrow(tidy(build), _FILTER)
    return built.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(merge), _FILTER)


def routing(prints: DataFrame):
    """A column function: whether a fingerprint's quotient has one that is repeated in this column of them."""
    quotient_bits, block_bits = sizes_for(prints.count())
    inner = quotient_bits - block_bits

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, one bit for every quotient with a fingerprint whose counter is above one."""
        for batch in batches:
            for block, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not parts[5]:
                    continue
                own, counts = unpack(block, parts, quotient_bits, block_bits)
                bits = np.zeros(1 << inner, bool)
                bits[(own[counts > 1] >> np.uint64(64 - quotient_bits)).astype(np.int64) & ((1 << inner) - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    # Together 2^(quotient_bits - 3) bytes at most.
    occupied = np.zeros((1 << block_bits, 1 << (inner - 3)), np.uint8)
    for row in merged_filter(prints, quotient_bits, block_bits).mapInArrow(tidy(repeated), "block int, bits binary").collect():
        occupied[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    shared = prints.sparkSession.sparkContext.broadcast(occupied.reshape(-1))

    @F.pandas_udf("boolean")
    def routed(prints):
        quotients = prints.to_numpy().view(np.uint64) >> np.uint64(64 - quotient_bits)
        bits = shared.value[(quotients >> np.uint64(3)).astype(np.int64)]
        return pd.Series(((bits >> (7 - (quotients & np.uint64(7))).astype(np.uint8)) & 1).astype(bool))

    return routed


def verified(source: DataFrame, routed) -> DataFrame:
    """Groups of equal texts among the routed rows of (_id, _norm, _print), by all of their bytes."""
    return (
        source.where(routed("_print"))
        .groupBy("_print", "_norm")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("_print", _digest().alias("_sha"), "keep_id", "group_size")
    )


def _digest() -> Column:
    return F.unhex(F.sha2("_norm", 256))


def _kept() -> Column:
    return F.coalesce(F.col("_id") == F.coalesce("keep_id", "_id"), F.col("keep_id").isNull())


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of (_id, _print, _sha, ...) with their groups; hot ones are dealt out by id."""
    # One row for HOT rows of the corpus at most.
    hot = groups.where(F.col("group_size") >= HOT).select("_print").distinct().withColumn("_hot", F.lit(True))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("_id"), F.lit(PARTS))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(hot), "_print", "left").withColumn("_part", part).drop("_hot")
    # Another group of a hot fingerprint is dealt out like it.
    copies = groups.join(F.broadcast(hot), "_print", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), PARTS - 1).otherwise(0)))).drop("_hot")
    return dealt.join(copies, ["_print", "_sha", "_part"], "left").drop("_part")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the digest of the normalised text."""
    source = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm")).withColumn("_print", F.xxhash64("_norm"))
    prints = materialize(source.select("_id", "_print", _digest().alias("_sha")), "prints")
    groups = materialize(verified(source, routing(prints.select("_print"))), "groups")
    return _with_groups(prints, groups).select(
        F.col("_id").alias(id_col),
        F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        _kept().alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Texts that surely have no copy are not shuffled."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.withColumn("_print", F.xxhash64("_norm"))
    routed = routing(rows.select("_print"))
    groups = materialize(verified(rows, routed), "groups")
    alone = rows.where(~routed("_print")).select("_row.*")
    of_groups = rows.where(routed("_print")).select("_row", "_id", "_print", _digest().alias("_sha"))
    met = _with_groups(of_groups, groups).where(_kept())
    # Of rows that repeat the keeper's id and text, and of groups without any id, one stays.
    one = met.where("group_size IS NOT NULL").dropDuplicates(["_print", "_sha"]).select("_row.*")
    return alone.union(met.where("group_size IS NULL").select("_row.*")).union(one)
