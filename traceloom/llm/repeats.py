"""Removal of repeated substrings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every byte goes that a string of LEAST bytes covers which also starts somewhere else.

1. Where equal strings meet. Of the GRAM-byte grams in a string of LEAST bytes, the one of least hash is its
   anchor, so equal strings have equal anchors at the same place. The strings of one anchor start in a range of
   places before it, cut in two halves. A half is known by its core, the bytes that all its strings share, and its
   span, the bytes that any of them has (64 bits of the core's hash, 96 further bits of the span's). Equal cores and
   spans of a task are counted there, and one entry of them is shuffled by core, and no text with it.
2. What the hashes settle. A core that occurs once has no repeated string. A span that occurs again is repeated
   whole. What is left are cores with different spans: texts that agree around the anchor and part nearby.
3. A core of more than CROWD different spans (a passage in very many documents) is expanded first: its ranges of
   starts are cut in PARTS, which have longer cores, and go through step 2 again, until a core has CROWD spans at
   most. A range of one start has its core for a span, so this ends.
4. Spans of the other cores go to blocks, all of a core to one block. A block is a text of its own, whose
   Burrows-Wheeler transform is expanded breadth first: the interval of a string is extended to the left by every
   letter in it, and the end of each new interval is a border between suffixes whose common prefix is the string's
   length. Expansion stops at LEAST; what has no border by then are suffixes with LEAST bytes in common.
5. The covered stretches of each document are united and cut out.

A text of more than WINDOW bytes is hashed in windows: each takes the strings that start in it, and sees LEAST bytes
before and twice as many behind. Defined cases: a null text equals the empty text; texts of fewer than LEAST bytes stay
whole; rows that repeat id and text are occurrences of each other; ids may be null or repeated; an empty table gives
an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from traceloom.llm.common import materialize, tidy, utf8_parts
from traceloom.llm.hashing import Hashes, id_map, in_map, mix

LEAST = 200
GRAM = 32
#: Different spans of one core that are expanded together, and the parts in which ranges of others are cut.
CROWD, PARTS = 4_096, 4
#: Bytes of one Burrows-Wheeler transform, about.
BLOCK_BYTES = 1 << 19
#: Bytes of entries for each task of step 2, and of spans for each of step 4, about; tasks at least.
TASK_BYTES, SPAN_BYTES, TASKS = 8 << 20, 4 << 20, 6
#: Fragments for each task, so that hashing them to tasks leaves none with much more than its share.
EACH = 6
#: Bytes of text that are hashed at a time; entries of a task that are counted together.
SLICE, COUNTED = 1 << 20, 400_000
#: Bytes of the windows in which longer texts are hashed.
WINDOW = 4 << 20
#: Bits of the maps of documents that have anything to settle or to remove.
MAP_BITS = 26

_U = np.uint64
_PLACE = _U((1 << 26) - 1)  # places in a window, or in a slice
_HALF = (LEAST - GRAM) // 2  # starts 0.._HALF before the anchor, and _HALF + 1..LEAST - GRAM
#: A range of starts: the first one, how many more, how far the first lies before the anchor, and between which
#: distances before the anchor the range lies that it is a part of.
_RANGE = [("start", "<u4"), ("more", "<u1"), ("back", "<u1"), ("near", "<u1"), ("far", "<u1")]
#: core, span and more bits of it, owner (place in the table of keys), how often
_ENTRY = np.dtype([("core", "<u8"), ("span", "<u8"), ("check", "<u4"), ("owner", "<u4"), *_RANGE, ("times", "<u1")])
_REQUEST = np.dtype([("core", "<u8"), *_RANGE, ("open", "<u1")])
_STRETCH = np.dtype([("start", "<u4"), ("end", "<u4")])
#: A document's key: 128 bits of a hash of its id and text.
_KEY = np.dtype("V16")
_KINDS = {"fragment": pa.int32(), "keys": pa.binary(), "entries": pa.binary()}
_FOUND = {"_key": pa.binary(), "kind": pa.int32(), "payload": pa.binary(), "bytes": pa.int64()}


def anchors(data: np.ndarray, offsets: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of LEAST bytes within one text: place, and the first and the last start."""
    none = np.empty(0, np.int64)
    if len(data) < LEAST:
        return none, none, none
    wide = LEAST - GRAM + 1
    keys = (hashes.every(GRAM) & ~_PLACE) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    n = len(keys)
    padded = np.full(-(-n // wide) * wide + wide, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(n - wide + 1)
    least = np.minimum(behind[: len(starts)], ahead[wide - 1 : wide - 1 + len(starts)])
    inside = np.repeat(offsets[1:], np.diff(offsets))[: len(starts)] >= starts + LEAST
    starts, chosen = starts[inside], (least[inside] & _PLACE).astype(np.int64)
    if not len(starts):
        return none, none, none
    # A range ends where the anchor changes, or where starts are not neighbours because a text ends between.
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return chosen[new], starts[new], starts[np.r_[new[1:], len(starts)] - 1]


def _entries(hashes: Hashes, owner: np.ndarray, base: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Entries of the strings that start from ``low`` to ``high`` in the buffer, whose anchors are ``at`` and whose range
    is ``near`` to ``far`` before it. ``base``: where each owner's text begins."""
    out = np.empty(len(at), _ENTRY)
    about = mix((near.astype(np.uint64) << _U(8)) | far.astype(np.uint64))
    # The core is taken over the range as such, so that a text's end cuts the span only.
    out["core"] = hashes.of(at - near, at - far + LEAST) ^ about
    out["span"] = hashes.of(low, high + LEAST) ^ mix((at - low).astype(np.uint64) + about)
    out["check"] = (hashes.of(low, high + LEAST, lane=1) >> _U(32)).astype(np.uint32)
    out["owner"], out["start"], out["more"], out["back"] = owner, low - base, high - low, at - low
    out["near"], out["far"], out["times"] = near, far, 1
    return out


def halves(data: np.ndarray, offsets: np.ndarray, low_start: int = 0, high_start: int | None = None) -> np.ndarray:
    """Entries of all halves of all anchors' ranges; ``owner`` is the text's place, starts are relative to the text.
    With bounds (for one text), only strings that start within them are looked for."""
    hashes = Hashes(data)
    place, first, last = anchors(data, offsets, hashes)
    high_start = len(data) if high_start is None else high_start
    found = []
    for near, far in ((0, _HALF), (_HALF + 1, LEAST - GRAM)):
        # All starts of the half that the text has, whether or not the anchor is theirs: neighbours don't matter then.
        touched = (last >= place - far) & (first <= place - near)
        at = place[touched]
        row = np.searchsorted(offsets, at, side="right") - 1
        low = np.maximum(np.maximum(at - far, offsets[row]), low_start)
        high = np.minimum(np.minimum(at - near, offsets[row + 1] - LEAST), high_start - 1)
        keep = high >= low
        at, row, low, high = at[keep], row[keep], low[keep], high[keep]
        found.append(_entries(hashes, row, offsets[row], at, low, high, np.full(len(at), near), np.full(len(at), far)))
    return np.concatenate(found)


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int | None]]:
    """Stretches of a buffer of texts that are hashed together: rows from and to, bytes from and to, window's begin.

    Texts go together up to SLICE bytes; a text of more than WINDOW bytes goes in windows, with bytes around them."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
        size = int(offsets[stop] - offsets[start])
        if stop == start + 1 and size > WINDOW:
            for begin in range(0, size, WINDOW):
                yield start, stop, max(0, begin - LEAST), min(size, begin + WINDOW + 2 * LEAST), begin
        else:
            yield start, stop, 0, size, None
        start = stop


def _blobs(fragment: np.ndarray, keys: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Entries by fragment, each with the keys of the texts that they are of."""
    order = np.argsort(fragment, kind="stable")
    names = fragment[order]
    cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True][: len(names) + 1]) if len(names) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = entries[order[a:b]].copy()
        used, own["owner"] = np.unique(own["owner"], return_inverse=True)
        yield int(names[a]), keys[used].tobytes(), own.tobytes()


def _batch(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _keys_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _KEY)


def _counted(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of which one stands for all equal ones of this task, and those that are repeated here already."""
    order = np.lexsort((entries["check"], entries["span"], entries["core"]))
    entries = entries[order]
    same = (entries["core"][1:] == entries["core"][:-1]) & (entries["span"][1:] == entries["span"][:-1]) & (entries["check"][1:] == entries["check"][:-1])
    new = np.flatnonzero(np.r_[True, ~same][: len(entries)])
    times = np.diff(np.r_[new, len(entries)])
    repeated = np.repeat(times > 1, times)
    one = entries[new].copy()
    one["times"] = np.minimum(times, 2)
    return one, entries[repeated]


def _hand_on(parts: list[tuple[np.ndarray, np.ndarray]], fragments: int) -> Iterator[pa.RecordBatch]:
    """From (keys, entries) of slices: blobs of counted entries by fragment, and (fragments below 0) what is repeated here."""
    shift = np.cumsum([0] + [len(keys) for keys, _ in parts])
    keys, entries = np.concatenate([k for k, _ in parts]), np.concatenate([e for _, e in parts])
    entries["owner"] += np.repeat(shift[:-1], [len(e) for _, e in parts]).astype(np.uint32)
    one, repeated = _counted(entries)
    fragment = ((one["core"] >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64)
    # Below 0, and by core like the others.
    own = -1 - ((repeated["core"] >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64)
    rows = list(_blobs(fragment, keys, one)) + list(_blobs(own, keys, repeated))
    for i in range(0, len(rows), 5_000):
        yield _batch(_KINDS, rows[i : i + 5_000])


def _entries_of(source: DataFrame, fragments: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            keys = _keys_of(batch.column(0))
            for start, stop, low, high, begin in pieces(offsets):
                base = offsets[start]
                if begin is None:
                    found = halves(data[base : base + high], offsets[start : stop + 1] - base)
                else:
                    found = halves(data[base + low : base + high], np.array([0, high - low]), begin - low, begin - low + WINDOW)
                    found["start"] += np.uint32(low)
                parts.append((keys[start:stop], found))
                held += len(found)
                if held > COUNTED:
                    yield from _hand_on(parts, fragments)
                    parts, held = [], 0
        if parts:
            yield from _hand_on(parts, fragments)

    return source.mapInArrow(tidy(run), "fragment int, keys binary, entries binary")


def _emit(kind: int, keys: np.ndarray, owner: np.ndarray, payload: np.ndarray, sizes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each document: its key, and its part of the payload."""
    by = np.argsort(owner, kind="stable")
    owner, payload = owner[by], payload[by]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    sums = np.add.reduceat(sizes[by], cuts) if sizes is not None and len(cuts) else np.zeros(len(cuts), np.int64)
    ends = np.r_[cuts[1:], len(owner)].astype(np.int64)
    rows = [(keys[owner[a]].tobytes(), kind, payload[a:b].tobytes(), n) for a, b, n in zip(cuts.tolist(), ends.tolist(), sums.tolist())]
    for i in range(0, len(rows), 5_000):
        yield _batch(_FOUND, rows[i : i + 5_000])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 for the fragments in this partition: rows (key, kind, payload, bytes). Kinds: 0 stretches that are
    repeated, 1 spans to compare, 2 ranges of crowded cores."""
    parts, names, known = [], [], 0
    for batch in batches:
        for fragment, own, blob in zip(*(column.to_pylist() for column in batch.columns)):
            keys, entries = np.frombuffer(own, _KEY), np.frombuffer(blob, _ENTRY)
            if fragment < 0:  # repeated within a task
                yield from _emit(0, keys, entries["owner"], _whole(entries))
                continue
            entries = entries.copy()
            entries["owner"] += np.uint32(known)
            known += len(keys)
            parts.append(entries)
            names.append(keys)
    if not parts:
        return
    entries, keys = np.concatenate(parts), np.concatenate(names)
    parts.clear(), names.clear()
    order = np.argsort(entries["core"], kind="stable")
    core = entries["core"][order]
    again = core[1:] == core[:-1]
    order = order[np.r_[again, False] | np.r_[False, again]] if len(core) > 1 else order[:0]
    if not len(order):
        return
    entries = entries[order]
    entries = entries[np.lexsort((entries["check"], entries["span"], entries["core"]))]
    new_core = np.r_[True, entries["core"][1:] != entries["core"][:-1]]
    new_span = new_core | np.r_[True, (entries["span"][1:] != entries["span"][:-1]) | (entries["check"][1:] != entries["check"][:-1])]
    first = np.flatnonzero(new_span)
    spans = np.cumsum(new_span) - 1
    times = np.add.reduceat(entries["times"].astype(np.int64), first)[spans]
    core_of = np.cumsum(new_core)[first] - 1
    different = np.bincount(core_of)
    unsettled = np.bincount(core_of, times[first] == 1) > 0
    asked = first[(different[core_of] > 1) & unsettled[core_of]]
    crowded = (different > CROWD)[np.cumsum(new_core)[asked] - 1]
    # An entry that stands for several has handed on its texts where it was counted.
    repeated = entries[(times > 1) & (entries["times"] == 1)]
    yield from _emit(0, keys, repeated["owner"], _whole(repeated))
    for kind, chosen in ((1, asked[~crowded]), (2, asked[crowded])):
        own = entries[chosen]
        request = np.empty(len(own), _REQUEST)
        for name in ("core", *(name for name, _ in _RANGE)):
            request[name] = own[name]
        request["open"] = times[chosen] == 1
        yield from _emit(kind, keys, own["owner"], request, own["more"].astype(np.int64) + LEAST)


def _whole(entries: np.ndarray) -> np.ndarray:
    stretch = np.empty(len(entries), _STRETCH)
    stretch["start"], stretch["end"] = entries["start"], entries["start"] + entries["more"].astype(np.uint32) + np.uint32(LEAST)
    return stretch


def _asked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The requests of a batch's rows, and the row of each."""
    own = [np.frombuffer(b"".join(requests), _REQUEST) for requests in batch.column(2).to_pylist()]
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)


def _by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 1_000):
            yield batch.slice(start, 1_000)


def _parts_of(asked: DataFrame, fragments: int) -> DataFrame:
    """Step 3, from (_key, _text, requests): entries of the parts of the asked ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_rows(batches):
            data, offsets = utf8_parts(batch.column(1))
            row, own = _asked(batch)
            start, more, back, near, far = (own[name].astype(np.int64) for name, _ in _RANGE)
            at = offsets[row] + start + back
            step = -(-(far - near + 1) // PARTS)
            hashes, found = Hashes(data), []
            for part in range(PARTS):
                # Cut by distance from the anchor, which is the same for equal strings.
                closest, farthest = near + part * step, np.minimum(far, near + (part + 1) * step - 1)
                low, high = np.maximum(closest, back - more), np.minimum(farthest, back)
                some = low <= high
                found.append(_entries(hashes, row[some], offsets[row[some]], at[some], (at - high)[some], (at - low)[some], closest[some], farthest[some]))
            yield from _hand_on([(_keys_of(batch.column(0)), np.concatenate(found))], fragments)

    return asked.mapInArrow(tidy(run), "fragment int, keys binary, entries binary")


def _spans_of(asked: DataFrame, fragments: int) -> DataFrame:
    """Step 4, from (_key, _text, requests): spans by fragment of their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"fragment": pa.int32(), "spans": pa.binary()}
        for batch in _by_rows(batches):
            data, offsets = utf8_parts(batch.column(1))
            keys, (row, own) = _keys_of(batch.column(0)), _asked(batch)
            fragment = ((own["core"] >> _U(32)) * _U(fragments) >> _U(32)).astype(np.int64)
            order = np.argsort(fragment, kind="stable")
            names = fragment[order]
            cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True])
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                pick = order[a:b]
                low = offsets[row[pick]] + own["start"][pick].astype(np.int64)
                size = own["more"][pick].astype(np.int64) + LEAST
                text = data[np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
                rows.append((int(names[a]), np.array([len(pick)], "<i8").tobytes() + keys[row[pick]].tobytes() + own[pick].tobytes() + text.tobytes()))
            yield _batch(kinds, rows)

    return asked.mapInArrow(tidy(run), "fragment int, spans binary")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a cyclic text, sorted by ``depth`` letters at least; prefix doubling from 8 letters on."""
    n = len(text)
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys = (keys << _U(8)) | np.roll(text, -k).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_keys = keys[order]
    heads = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    known = 8
    while known < depth:
        # Only suffixes that share their rank are sorted again, within the places that they have.
        tied = ~(heads & np.r_[heads[1:], True])
        places = np.flatnonzero(tied)
        if not len(places):
            break
        own = order[places]
        second = rank[(own + known) % n]
        resort = np.argsort(rank[own] * n + second, kind="stable")
        own, second = own[resort], second[resort]
        first = rank[own]
        order[places] = own
        heads[places] = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        known *= 2
    return order


def expand(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of a cyclic text, and where in it a border stands between suffixes that have fewer than
    ``least`` letters in common. Breadth-first backward extension on the transform: all borders of common prefixes
    of 0 letters are found first, then those of 1 letter, and so on; an interval whose end was a border before is
    not extended further, as its extensions end at known borders too."""
    n = len(text)
    order = suffix_order(text, least + 1)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    previous = (order - 1) % n
    transform = text[previous].astype(np.int64)  # the Burrows-Wheeler transform
    back = rank[previous]  # its mapping from last to first letters
    border = np.zeros(n + 1, bool)
    border[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        size = high - low
        inside = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        child = np.repeat(np.arange(len(low), dtype=np.int64), size) << 8 | transform[inside]
        to = back[inside]
        if len(low) > 1 or n < 1 << 16:
            by = np.argsort(child, kind="stable")
        else:
            by = np.argsort(child.astype(np.uint8), kind="stable")
        child, to = child[by], to[by]
        starts = np.flatnonzero(np.r_[True, child[1:] != child[:-1]])
        lows, highs = np.minimum.reduceat(to, starts), np.maximum.reduceat(to, starts) + 1
        new = ~border[highs]
        low, high = lows[new], highs[new]
        border[high] = True
        if not len(low):
            break
    return order, border


def repeated_strings(spans: np.ndarray, sizes: np.ndarray, names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every byte of some spans laid end to end: whether the string of LEAST bytes that starts there is in its
    span whole and also starts at another place of the corpus. ``names``, ``first``: the spans' texts and places."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    # A byte that UTF-8 never has stands after every span.
    text = np.full(total + len(sizes), 0xFF, np.uint8)
    at = np.arange(total) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = spans
    order, border = expand(text, LEAST)
    span = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(total) - np.repeat(ends - sizes, sizes)
    place = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        place[at] = mix(names[span] + mix((first[span] + inside).astype(np.uint64)))
    # Suffixes between two borders are of one string; it is repeated if they are of more than one place.
    starts = np.flatnonzero(np.r_[True, border[1:-1]])
    own = place[order]
    several = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
    out = np.empty(len(text), bool)
    out[order] = np.repeat(several, np.diff(np.r_[starts, len(text)]))
    return out[at] & (inside + LEAST <= sizes[span])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4 for the fragments in this partition: stretches that are repeated."""
    names, heads, texts = [], [], []
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            count = int(np.frombuffer(blob, "<i8", 1)[0])
            names.append(np.frombuffer(blob, _KEY, count, 8))
            heads.append(np.frombuffer(blob, _REQUEST, count, 8 + 16 * count))
            texts.append(np.frombuffer(blob, np.uint8, -1, 8 + (16 + _REQUEST.itemsize) * count))
    if not heads:
        return
    name, head, text = np.concatenate(names), np.concatenate(heads), np.concatenate(texts)
    names.clear(), heads.clear(), texts.clear()
    halves_of = name.view("<u8").reshape(-1, 2)
    document = halves_of[:, 0] ^ mix(halves_of[:, 1].copy())
    size = head["more"].astype(np.int64) + LEAST
    begin = np.cumsum(size) - size
    order = np.argsort(head["core"], kind="stable")
    new = np.flatnonzero(np.r_[True, head["core"][order][1:] != head["core"][order][:-1]])
    # Whole cores are taken together until a block is full.
    weight = np.cumsum(np.add.reduceat(size[order], new))
    block = (weight - 1) // BLOCK_BYTES
    edges = np.r_[new[np.r_[True, block[1:] != block[:-1]]], len(order)]
    owners, starts = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        pick = order[a:b]
        own = size[pick]
        letters = text[np.repeat(begin[pick] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        found = repeated_strings(letters, own, document[pick], head["start"][pick].astype(np.int64))
        found &= np.repeat(head["open"][pick] == 1, own)
        at = np.flatnonzero(found)
        span = np.repeat(np.arange(len(pick)), own)[at]
        owners.append(pick[span])
        starts.append(head["start"][pick][span].astype(np.int64) + at - (np.cumsum(own) - own)[span])
    owner, start = np.concatenate(owners), np.concatenate(starts)
    if not len(owner):
        return
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + LEAST)][: len(owner)])
    stretch = np.empty(len(new), _STRETCH)
    stretch["start"], stretch["end"] = start[new], start[np.r_[new[1:], len(start)].astype(np.int64) - 1] + LEAST
    yield from _emit(0, name, owner[new], stretch)


def _cut(texts: DataFrame, kind: str) -> DataFrame:
    """From (_id, _text, payloads): the text's bytes without the stretches, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            sizes, removed, spans, digests = [], [], [], []
            for i, payloads in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                sizes.append(len(own))
                if not payloads:
                    removed.append(0), spans.append(0), digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                    continue
                stretch = np.concatenate([np.frombuffer(p, _STRETCH) for p in payloads])
                depth = np.zeros(len(own) + 1, np.int64)
                np.add.at(depth, stretch["start"].astype(np.int64), 1)
                np.add.at(depth, stretch["end"].astype(np.int64), -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return texts.select("_id", "_text", "payloads").mapInArrow(tidy(run), f"_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


_SCHEMA = "_key binary, kind int, payload binary, bytes bigint"


def _slot() -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(1 << MAP_BITS))


def _with_requests(source: DataFrame, found: DataFrame) -> DataFrame:
    """(_key, _text, requests) of the documents that are asked for anything; one row where rows repeat id and text."""
    asked = found.groupBy("_key").agg(F.collect_list("payload").alias("requests"))
    wanted = in_map(id_map(found.select(_slot().alias("slot")).distinct(), MAP_BITS))
    return source.select("_key", "_text").where(wanted(_slot())).join(asked, "_key").select("_key", "_text", "requests")


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts (_id, _key, _text) and their repeated stretches (_key, payload)."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    key = F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(lane), "_id", "_text")), 16, "0") for lane in ("one", "two"))))
    source = source.select("_id", key.alias("_key"), "_text")
    total = source.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    # An entry has 33 bytes, and there is about one for 50 bytes of text.
    fragments = max(TASKS, math.ceil(total / 2 / TASK_BYTES))
    entries = _entries_of(source.select("_key", "_text"), EACH * fragments)
    stretches, spans = [], []
    while True:
        settled = materialize(entries.repartition(fragments, "fragment").mapInArrow(tidy(_settle), _SCHEMA), "settled")
        stretches.append(settled.where("kind = 0").select("_key", "payload"))
        spans.append(settled.where("kind = 1"))
        crowded = settled.where("kind = 2")
        work = crowded.agg(F.sum("bytes").alias("n")).first()["n"]
        if not work:
            break
        # Ranges get shorter in each round, and those of one start are never crowded.
        fragments = max(TASKS, math.ceil(work / TASK_BYTES))
        entries = _parts_of(_with_requests(source, crowded), EACH * fragments)
    whole, asked = (reduce(DataFrame.unionByName, frames) for frames in (stretches, spans))
    work = asked.agg(F.sum("bytes").alias("n")).first()["n"]
    if work:
        tasks = max(TASKS, math.ceil(work / SPAN_BYTES))
        spread = _spans_of(_with_requests(source, asked), EACH * tasks).repartition(tasks, "fragment")
        whole = whole.unionByName(materialize(spread.mapInArrow(tidy(_compare), _SCHEMA), "compared").select("_key", "payload"))
    return source, whole


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans and the digest of what is kept."""
    source, stretches = repeated_stretches(docs, id_col, text_col)
    kind = source.schema["_id"].dataType.simpleString()
    touched = in_map(id_map(stretches.select(_slot().alias("slot")).distinct(), MAP_BITS))
    flagged = source.withColumn("_touched", touched(_slot()))
    none = F.lit(None).cast("array<binary>").alias("payloads")
    # Texts without any stretch are finished where they are read; the others meet their stretches.
    plain = _cut(flagged.where(~F.col("_touched")).select("_id", "_text", none), kind)
    payloads = stretches.groupBy("_key").agg(F.collect_list("payload").alias("payloads"))
    cut = _cut(flagged.where("_touched").join(payloads, "_key", "left").select("_id", "_text", "payloads"), kind)
    return plain.unionByName(cut).withColumnRenamed("_id", id_col)
