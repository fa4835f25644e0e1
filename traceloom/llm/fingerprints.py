"""Document fingerprints by content-defined chunking.

A gear hash of the last WINDOW bytes decides where a text may be cut: after the smallest size of a chunk at places whose
hash has STRICT zero bits, after the normal size at places with LOOSE ones, and at the largest size in any case, so that
sizes gather about the normal one. Cuts depend on nearby bytes only, so an edit changes the chunks around it and no others.
A text's fingerprint is the set of its chunks' 64-bit digests, each weighted by the bytes that it covers, repeats added; its
likeness to another fingerprint is its containment there, the share of its bytes that the other covers by the same chunks.

Each document is also held against an edited text, which ends in the beginning of the next document by descending doc_id,
and against that document. Documents are dealt to ranges of this order by a light pass over ids and texts' hashes; texts are
shuffled once, straight to their range, with the first document of the next range behind them, so that no task looks into
another and no text is written. A range's texts stream through in order, one batch at a time.

Defined cases: a null text equals the empty one; rows without an id come last in the order, and rows of equal id follow by
their text's hash (equal rows are documents of their own); one document alone is its own next; the empty text has the empty
fingerprint, which is wholly like itself and not at all like others; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import materialize, tidy
from traceloom.llm.hashing import Hashes

#: Bytes that a cut depends on, and of a chunk: at least, normally, at most.
WINDOW, LEAST, NORMAL, MOST = 16, 16, 48, 192
#: Zero bits that a cut's hash has before the normal size, and after it.
STRICT, LOOSE = 7, 4
#: Bytes of text that are cut in one run, about.
SLICE = 4 << 20
#: One random number for each byte.
GEAR = np.random.default_rng(12).integers(0, 2**64, 256, np.uint64)
_ENTRY = np.dtype([("digest", "<u8"), ("bytes", "<u4")])
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def cut_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all chunks of the texts that lie in a buffer, in order.

    All texts of the buffer advance together, by one chunk a step. Windows that reach into the text before are never asked,
    as no chunk is shorter than the window."""
    size = len(data)
    gear = GEAR[data]
    width = 1
    while width < WINDOW:
        gear[width:] += gear[:-width] << np.uint64(width)
        width *= 2
    # The last position of a chunk is the one whose window ends there; bits that all bytes of the window reach.
    high = gear >> np.uint64(64 - STRICT)

    def following(hits: np.ndarray) -> np.ndarray:
        """For each place the next end of a chunk from there on."""
        at = np.full(size + MOST + 2, size + MOST, np.int64)
        at[1 : size + 1][hits] = np.flatnonzero(hits) + 1
        return np.minimum.accumulate(at[::-1])[::-1]

    strict, loose = following(high == 0), following(high >> np.uint64(STRICT - LOOSE) == 0)
    text, at = np.flatnonzero(ends > starts), starts[ends > starts].astype(np.int64)
    found = []
    while len(text):
        end = strict[at + LEAST] if len(at) else at
        end = np.where(end < at + NORMAL, end, loose[np.minimum(at + NORMAL, size)])
        end = np.minimum(np.minimum(end, at + MOST), ends[text])
        found.append((text, at, end))
        more = end < ends[text]
        text, at = text[more], end[more]
    if not found:
        return (np.empty(0, np.int64),) * 3
    text, start, end = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, text))
    return text[order], start[order], end[order]


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The chunks of each text as (digest, bytes covered), ascending."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    text, start, end = cut_places(data, ends - sizes, ends)
    digests, lengths = Hashes(data).of(start, end), end - start
    order = np.lexsort((digests, text))
    text, digests, lengths = text[order], digests[order], lengths[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (digests[1:] != digests[:-1])][: len(text)])
    entries = np.empty(len(first), _ENTRY)
    entries["digest"], entries["bytes"] = digests[first], np.add.reduceat(lengths, first) if len(first) else 0
    at = np.searchsorted(text[first], np.arange(len(texts) + 1))
    return [entries[a:b] for a, b in zip(at[:-1], at[1:])]


def written(entries: np.ndarray) -> str:
    """A fingerprint as a string: twelve bytes a chunk, in base64."""
    return base64.b64encode(entries.tobytes()).decode()


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """The share of a fingerprint's bytes that another one covers by the same chunks."""
    if not len(own) or not len(other):
        return float(len(own) == len(other))
    at = np.minimum(np.searchsorted(other["digest"], own["digest"]), len(other) - 1)
    both = np.where(other["digest"][at] == own["digest"], np.minimum(other["bytes"][at], own["bytes"]), 0)
    return float(both.sum(dtype=np.int64) / own["bytes"].sum(dtype=np.int64))


def in_order(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, text, extra) of one range of the descending order in each partition, sorted; the row that follows a range comes
    once more at its end, as ``extra``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = [F.desc_nulls_last("id"), F.asc("hash")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = materialize(rows.select("id", "hash"), "order").repartitionByRange(n, *order)
    heads = light.groupBy(F.spark_partition_id().alias("_range")).agg(F.min(F.struct(F.col("id").isNull().alias("last"), (-F.col("id")).alias("falling"), "hash")).alias("head"))
    # One row a range.
    first = sorted((r["last"], r["falling"] or 0, r["hash"]) for r in heads.select("head.*").toLocalIterator())
    keys = np.array(first, dtype=[("last", "?"), ("falling", "i8"), ("hash", "i8")])

    @F.pandas_udf("range int, head boolean")
    def placed(ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        asked = np.empty(len(ids), keys.dtype)
        asked["last"], asked["hash"] = ids.isna().to_numpy(), hashes.to_numpy()
        asked["falling"] = -ids.fillna(0).astype("int64").to_numpy()
        at = np.searchsorted(keys, asked, side="right") - 1
        return pd.DataFrame({"range": at.astype("int32"), "head": keys[at] == asked})

    if not len(keys):
        return rows.select("id", "text", F.lit(False).alias("extra"))
    rows = rows.withColumn("at", placed("id", "hash"))
    ranges = F.array(F.struct(F.col("at.range").alias("range"), F.lit(False).alias("extra")))
    before = F.struct(F.pmod(F.col("at.range") - 1, F.lit(len(keys))).alias("range"), F.lit(True).alias("extra"))
    rows = rows.select("id", "text", "hash", F.explode(F.when(F.col("at.head"), F.array_append(ranges, before)).otherwise(ranges)).alias("_to"))
    rows = rows.select("id", "text", "hash", "_to.*").repartitionById(len(keys), "range")
    return rows.sortWithinPartitions("extra", *order).select("id", "text", "extra")


def compare_with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def results(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all documents but the last, which is only the next one."""
        edited = [(own[: len(own) - len(own) // 2] + after[: len(own) // 2]).encode() for own, after in zip(texts, texts[1:])]
        prints, changed = fingerprints([t.encode() for t in texts]), fingerprints(edited)
        columns = {
            "doc_id": pa.array(ids[:-1], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array([written(p) for p in prints[:-1]], pa.string()),
            "edited_fingerprint": pa.array([written(p) for p in changed], pa.string()),
            "near_edited": pa.array([containment(a, b) for a, b in zip(prints, changed)], pa.float64()),
            "near_next": pa.array([containment(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, over = [], [], 0, False
        for batch in batches:
            for k in range(batch.num_rows):
                if over:
                    continue
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py())
                size += len(texts[-1])
                # Rows equal to a range's first one all come as extras; one of them is enough.
                over = batch.column(2)[k].as_py()
                if size > SLICE and len(texts) > 1:
                    yield results(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield results(ids, texts)

    return in_order(docs, text_col, id_col).mapInArrow(tidy(run), _SCHEMA)
