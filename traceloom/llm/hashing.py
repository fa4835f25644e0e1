"""Hashes of stretches of a byte buffer, and bit maps of hashed ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from traceloom.llm.common import tidy

_U = np.uint64
_P, _M = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Odd factors of the two lanes of a digest.
_LANES = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
#: Bytes of a stretch that are hashed in one run.
_PIECE = 512
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _M
        x = (x ^ (x >> _U(29))) * _P
        return x ^ (x >> _U(32))


def chain(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours."""
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = mix(words[:n])
        for k in range(1, width):
            out = mix(out * _P ^ words[k : n + k])
        return out


class Hashes:
    """Hashes of stretches of a buffer; equal bytes of equal length have equal hashes, wherever they stand.

    A stretch is read eight bytes at a time, and each step multiplies and shifts, so that no two patterns of letters
    cancel each other, as they can in sums of powers. Two lanes with factors of their own make 128 bits."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        padded = np.zeros(self.size + 8, np.uint8)
        padded[: self.size] = data
        # The eight bytes from each place on.
        self.eights = np.ndarray((self.size + 1,), "<u8", padded, strides=(1,))

    def of(self, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
        start, size = np.asarray(start, np.int64), np.asarray(end - start, np.int64)
        long = np.flatnonzero(size > _PIECE)
        if not len(long):
            return self._steps(start, size, lane)
        # Long stretches are hashed by pieces, and then the pieces' hashes like bytes.
        out = self._steps(start, np.minimum(size, _PIECE), lane)
        pieces = -(-size[long] // _PIECE)
        ends = np.cumsum(pieces)
        at = _PIECE * (np.arange(ends[-1]) - np.repeat(ends - pieces, pieces))
        inner = self._steps(np.repeat(start[long], pieces) + at, np.minimum(np.repeat(size[long], pieces) - at, _PIECE), lane)
        out[long] = mix(Hashes(inner.view(np.uint8)).of(8 * (ends - pieces), 8 * ends, lane) ^ size[long].astype(np.uint64))
        return out

    def _steps(self, start: np.ndarray, left: np.ndarray, lane: int) -> np.ndarray:
        factor = _LANES[lane]
        with np.errstate(over="ignore"):
            out = mix(left.astype(np.uint64) + factor)
            order = np.argsort(-left, kind="stable")
            at, left, state = start[order], left[order], out[order]
            live = int(np.searchsorted(-left, 0, side="left"))
            while live:
                block = self.eights[at[:live]] & _KEPT[np.minimum(left[:live], 8)]
                own = (state[:live] ^ block) * factor
                state[:live] = own ^ (own >> _U(31))
                at[:live] += 8
                left[:live] -= 8
                if left[live - 1] <= 0:
                    live = int(np.searchsorted(-left[:live], 0, side="left"))
            out[order] = mix(state)
        return out

    def every(self, length: int) -> np.ndarray:
        """Hashes of all stretches of a length, which is a power of two from 8 on."""
        out, known = np.array(self.eights[: max(0, self.size - 7)]), 8
        with np.errstate(over="ignore"):
            while known < length:
                n = max(0, len(out) - known)
                out = out[:n] * _P ^ out[known : known + n]
                out ^= out >> _U(29)
                known *= 2
        return mix(out)


def id_map(slots: DataFrame, bits: int):
    """A broadcast bit map of the slots (0 to 2^bits - 1) in a one-column table: 2^(bits - 3) bytes, whatever the
    corpus holds. It only spares a shuffle what surely doesn't join; the join itself decides."""
    blocks = 256
    width = (1 << bits) // blocks
    name = slots.columns[0]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            own = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            for block in np.unique(own // width).tolist():
                maps.setdefault(block, np.zeros(width, bool))[own[own // width == block] % width] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], names=["block", "bits"])

    whole = np.zeros((blocks, width // 8), np.uint8)
    marked = slots.select(F.col(name).cast("long")).repartition(F.floor(F.col(name) / width)).mapInArrow(tidy(mark), "block int, bits binary")
    for row in marked.collect():
        whole[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return slots.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def in_map(shared):
    """A column function: whether a slot is in the bit map."""

    @F.pandas_udf("boolean")
    def hit(slots):
        import pandas as pd

        at = slots.to_numpy()
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool))

    return hit


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", bits: int = 25) -> DataFrame:
    """The rows of ``docs`` whose id is not in the table ``dropped``; null ids stay. Only rows whose id may be in it
    are shuffled."""
    slot = F.pmod(F.xxhash64(id_col), F.lit(1 << bits))
    listed = in_map(id_map(dropped.select(slot.alias("slot")).distinct(), bits))
    return docs.where(~listed(slot)).union(docs.where(listed(slot)).join(dropped, id_col, "left_anti").select(*docs.columns))
