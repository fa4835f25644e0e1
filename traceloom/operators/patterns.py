"""Many patterns in many texts: which texts hold which strings, wherever they stand.

An index of grams is made of the patterns, and each pattern is looked for by the one of its grams that is rarest in the
texts; patterns with a gram that no text has are gone at once. Where a text has such a gram, the pieces around it that have
the place and size of a pattern are cut out, and pieces meet patterns by equality. So texts are never shuffled, no text
is compared with patterns one by one, and patterns that share a gram cost one piece for each of their shapes. What is sent
to the tasks is the list of shapes, ROUND of them at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from traceloom.scratch import materialize

GRAM = 3
#: Shapes (gram, place, size) that are looked for in one pass over the texts.
ROUND = 200_000
#: Grams that a task holds before it adds up those that are equal.
HELD = 1_000_000
#: Pieces that a task hands on at a time.
PIECES = 50_000


def _codes(text: str, size: int) -> np.ndarray:
    """One number for each run of ``size`` characters, 21 bits a character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = points[:n].copy()
    for k in range(1, size):
        out = out << 21 | points[k : n + k]
    return out


def _gram(code: int, size: int) -> str:
    return "".join(chr(code >> 21 * k & 0x1FFFFF) for k in range(size - 1, -1, -1))


def gram_counts(texts: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """(gram, n) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {size: (np.empty(0, np.int64), np.empty(0, np.int64)) for size in sizes}
        held, waiting = {size: [] for size in sizes}, 0

        def add_up() -> None:
            for size, own in held.items():
                codes, counts = np.unique(np.concatenate(own or [np.empty(0, np.int64)]), return_counts=True)
                both = np.concatenate([known[size][0], codes])
                codes, at = np.unique(both, return_inverse=True)
                total = np.zeros(len(codes), np.int64)
                np.add.at(total, at, np.concatenate([known[size][1], counts]))
                known[size] = codes, total
                own.clear()

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for size in sizes if text else ():
                    held[size].append(_codes(text, size))
                    waiting += len(held[size][-1])
                if waiting > HELD:
                    add_up()
                    waiting = 0
        add_up()
        for size, (codes, counts) in known.items():
            grams = [_gram(c, size) for c in codes.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts)], names=["gram", "n"])

    return texts.select(text_col).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def pattern_matches(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern_col: str = "pattern", shapes: int = ROUND) -> DataFrame:
    """(id, pattern, n): how often each row's text holds each pattern, overlaps included; rows without a match are left out.

    Null and empty patterns match nothing, null texts hold nothing, and a pattern that is given twice counts once."""
    given = patterns.select(F.col(pattern_col).alias("pattern")).where("length(pattern) > 0").distinct()
    given = materialize(given.withColumn("size", F.least(F.length("pattern"), F.lit(GRAM))), "patterns")
    sizes = sorted(r["size"] for r in given.select("size").distinct().collect())
    at = F.sequence(F.lit(1), F.length("pattern") - F.col("size") + 1)
    grams = given.select("pattern", F.posexplode(F.transform(at, lambda k: F.substr("pattern", k, "size"))).alias("at", "gram"))
    seen = gram_counts(texts, text_col, sizes)
    best = grams.join(seen, "gram").groupBy("pattern").agg(F.min(F.struct("n", "at", "gram")).alias("best"), F.count(F.lit(1)).alias("_met"))
    best = best.where(F.col("_met") == F.length("pattern") - F.least(F.length("pattern"), F.lit(GRAM)) + 1)
    index = materialize(best.select("pattern", "best.gram", "best.at", F.length("pattern").alias("length")), "grams")
    listed = materialize(index.select("gram", "at", "length").distinct(), "shapes")
    rounds = -(-listed.count() // shapes)
    schema = f"id {dict(texts.dtypes)[id_col]}, pattern string, n long"
    found = None
    for k in range(rounds):
        own = listed.where(F.pmod(F.xxhash64("gram"), F.lit(rounds)) == k)
        pieces = texts.select(F.col(id_col).alias("id"), text_col).mapInArrow(_cutter(own), schema)
        found = pieces if found is None else found.unionByName(pieces)
    if found is None:
        return texts.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return found.join(index.select("pattern"), "pattern").select(F.col("id").alias(id_col), "pattern", "n")


def _cutter(shapes: DataFrame):
    """A partition's function that cuts out the pieces with one of some shapes, each once a text."""
    by_code: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for row in shapes.toLocalIterator():
        size = len(row["gram"])
        by_code.setdefault(size, {}).setdefault(int(_codes(row["gram"], size)[0]), []).append((row["at"], row["length"]))
    shared = shapes.sparkSession.sparkContext.broadcast(by_code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(size, np.array(sorted(own), np.int64), own) for size, own in shared.value.items()]

        def handed_on(batch: pa.RecordBatch, rows: list[int], pieces: list[str], counts: list[int]) -> pa.RecordBatch:
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], names=["id", "pattern", "n"])

        for batch in batches:
            rows, pieces, counts = [], [], []
            for row, text in enumerate(batch.column(1)):
                if len(pieces) >= PIECES:
                    yield handed_on(batch, rows, pieces, counts)
                    rows, pieces, counts = [], [], []
                text, held = text.as_py(), {}
                for size, codes, own in known if text else ():
                    here = _codes(text, size)
                    near = codes[np.minimum(np.searchsorted(codes, here), len(codes) - 1)]
                    for at in np.flatnonzero(near == here).tolist():
                        for place, length in own[int(here[at])]:
                            start = at - place
                            if start >= 0 and start + length <= len(text):
                                piece = text[start : start + length]
                                held[piece] = held.get(piece, 0) + 1
                rows.extend([row] * len(held))
                pieces.extend(held)
                counts.extend(held.values())
            yield handed_on(batch, rows, pieces, counts)

    return run


def body_block(source: Column) -> Column:
    """What stands between a function's first opening and last closing brace; all of it if they don't enclose anything."""
    opens, closes = F.instr(source, "{"), F.length(source) + 1 - F.instr(F.reverse(source), "}")
    closed = F.instr(source, "}") > 0
    inside = F.substr(source, opens + 1, closes - opens - 1)
    return F.when(opens == 0, source).when(~closed, F.substr(source, opens + 1)).when(opens < closes, inside).otherwise(source)


def reverse_calls(bodies: DataFrame, callees: DataFrame) -> DataFrame:
    """(caller, callee_module, callee): calls of functions as texts show them, ``name(`` or ``name<``.

    bodies: caller, module, source; callees: module, name. Names with their module are found in all bodies, names alone in
    bodies of their own module; a name is found at the end of a longer one too."""
    named = callees.select("module", "name").distinct()
    bare = F.transform(F.array(F.lit("("), F.lit("<")), lambda end: F.concat(F.col("name"), end))
    full = F.transform(bare, lambda call: F.concat("module", F.lit("::"), call))
    asked = named.select(F.col("module").alias("callee_module"), F.col("name").alias("callee"), F.explode(bare).alias("pattern"), F.lit(False).alias("full"))
    asked = asked.unionByName(named.select(F.col("module").alias("callee_module"), F.col("name").alias("callee"), F.explode(full).alias("pattern"), F.lit(True).alias("full")))
    asked = materialize(asked, "calls")
    texts = bodies.select("caller", body_block(F.col("source")).alias("body"))
    hits = materialize(pattern_matches(texts, asked, "caller", "body").select("caller", "pattern"), "hits")
    qualified = hits.join(asked.where("full"), "pattern").select("caller", "callee_module", "callee")
    near = hits.join(bodies.select("caller", F.col("module").alias("callee_module")), "caller")
    own = near.join(asked.where("NOT full"), ["pattern", "callee_module"]).select("caller", "callee_module", "callee")
    return qualified.unionByName(own).distinct()
