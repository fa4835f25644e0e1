"""The trie of all conversations' prefixes, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it, and its smallest
member owns it. Members only get fewer on the way down, so each conversation owns a suffix of its own path (or nothing),
and every node is owned once. Sums over a subtree are therefore sums over the members of its top: the tokens of all
occurrences below it, less the tokens of the nodes that its members own there, are what sharing saves; a conversation
whose last node is childless and its own adds one leaf. One aggregation by prefix sums both, and no tree is walked.

Turns travel as two 64-bit lanes of their digest, never as texts. A prefix is named by its depth and the exclusive or of
its turns' lanes, each mixed with its place (128 bits). Places, prefixes and running sums are made in two steps, so that
one conversation of any length is spread over many tasks: rows are cut into ranges, a window runs within a range, and
each range adds what the ranges before it hold of the conversation that it continues (one row a range at most). A common
node is a key with partial aggregation; joins that meet a common key have one row for it on their other side and are split
by adaptive execution. The ids of conversations that end at a node are joined in ranges, and only the strings of the
ranges meet, streamed through the hash.

Defined cases: rows without a conv_id belong to no conversation; null roles and texts are empty; a null turn comes first,
and turns of equal number are ordered by the digest of role and text (repeated rows are turns of their own); a
conversation may have no turns and then ends at the root; without conversations there is no node; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from traceloom.llm.common import materialize, tidy

KEY = ["depth", "a", "b"]
#: Conversations that share a head are named by multiples of this; heads have fewer than HEADS turns.
FAMILY, HEADS = 5, 9
#: Bytes of joined ids in one row, about.
PART_BYTES = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: Sequence[str], xors: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Add ``place`` (from 1) by an order within a key, and for each column the value over the rows before as ``before_``
    it; a key's rows may be spread over any number of tasks."""
    cut = rows.repartitionByRange(key, *(F.asc_nulls_first(c) for c in order)).withColumn("_range", F.spark_partition_id())
    cut = materialize(cut, "ranges")
    totals = cut.groupBy("_range", key).agg(
        F.count(F.lit(1)).alias("_n"), *(F.bit_xor(c).alias(f"_{c}") for c in xors), *(F.sum(c).alias(f"_{c}") for c in sums)
    )
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_range", key, F.sum("_n").over(ahead).alias("_n"),
        *(F.bit_xor(f"_{c}").over(ahead).alias(f"_{c}") for c in xors), *(F.sum(f"_{c}").over(ahead).alias(f"_{c}") for c in sums),
    ).where("_n IS NOT NULL")
    own = Window.partitionBy("_range", key).orderBy(*(F.asc_nulls_first(c) for c in order))
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = cut.select(
        "*", F.row_number().over(own).cast("long").alias("_at"),
        *(F.coalesce(F.bit_xor(c).over(earlier), zero).alias(f"_own_{c}") for c in xors), *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"_own_{c}") for c in sums),
    )
    # At most one row a range: only the first key of a range can have begun before it.
    found = local.join(F.broadcast(carried), ["_range", key], "left")
    add = lambda c: F.coalesce(F.col(c), zero)
    return found.select(
        *rows.columns, (F.col("_at") + add("_n")).alias("place"),
        *(F.col(f"_own_{c}").bitwiseXOR(add(f"_{c}")).alias(f"before_{c}") for c in xors), *((F.col(f"_own_{c}") + add(f"_{c}")).alias(f"before_{c}") for c in sums),
    )


def placed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, bytes): each conversation's turns in order, as lanes of their digests and their texts' sizes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(digest).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    ordered = running(turns, "conv_id", ["turn", "digest"])
    return materialize(ordered.select("conv_id", "place", *_lanes("digest"), "bytes"), "placed")


def _lanes(*of: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), *of).alias(name) for k, name in enumerate("ab")]


def with_family_heads(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which each conversation's first turns are those of its family's first conversation.

    Conversation c takes h = crc32(decimal c) % HEADS turns of conversation c - c % FAMILY, or as many as it has, and goes on
    with its own turns after its own first h."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = placed.select("conv_id").distinct().select("conv_id", family.alias("family"), taken.alias("taken"))
    heads = placed.where((F.col("conv_id") == family) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "family")
    others = convs.where("conv_id <> family")
    given = others.join(heads, "family").where("place <= taken").select("conv_id", "place", "a", "b", "bytes")
    # Where a family's first conversation is too short, own turns move up.
    length = heads.groupBy("family").agg(F.max("place").alias("_length"))
    short = others.join(length, "family", "left").select("conv_id", (F.col("taken") - F.least("taken", F.coalesce("_length", F.lit(0)))).alias("_up")).where("_up > 0")
    kept = placed.where((F.col("conv_id") == family) | (F.col("place") > taken)).join(short, "conv_id", "left")
    kept = kept.select("conv_id", (F.col("place") - F.coalesce("_up", F.lit(0))).alias("place"), "a", "b", "bytes")
    return convs.select("conv_id"), given.unionByName(kept)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    lanes (a, b) of its prefix.

    convs: conv_id, each once; turns: conv_id, place (from 1, without gaps), a, b, bytes."""
    mixed = turns.select("conv_id", F.col("place").alias("depth"), *_lanes("place", "a", "b"), "bytes")
    path = running(mixed, "conv_id", ["depth"], ["a", "b"], ["bytes"])
    path = path.select(
        "conv_id", "depth", F.col("a").bitwiseXOR(F.col("before_a")).alias("a"), F.col("b").bitwiseXOR(F.col("before_b")).alias("b"),
        F.col("before_a").alias("up_a"), F.col("before_b").alias("up_b"), F.col("before_bytes").alias("before"), "bytes",
    )
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *(zero.alias(c) for c in path.columns[1:]))
    path = materialize(path.unionByName(root), "occurrences")

    nodes = path.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in ("up_a", "up_b", "before"))
    )
    nodes = materialize(nodes, "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.where("depth > 0").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialize(nodes, "nodes")

    # What comes before the nodes that a conversation owns, and whether its last node is childless and its own.
    owned = nodes.groupBy("conv_id").agg(F.min("before").alias("_unowned"), F.count_if(F.col("n_children") == 0).alias("_leaf"))
    whole = path.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("_end"), F.sum("bytes").alias("_total"))
    whole = whole.join(owned, "conv_id", "left").select(
        "conv_id", "_end", F.coalesce("_unowned", "_total").alias("_unowned"), F.coalesce("_leaf", zero).alias("_leaf")
    )
    whole = materialize(whole, "conversations")
    spared = path.select("conv_id", *KEY, "before").join(whole.select("conv_id", "_unowned", "_leaf"), "conv_id")
    sums = spared.groupBy(*KEY).agg(
        F.sum(F.greatest(F.col("_unowned") - F.col("before"), zero)).alias("saved_tokens"), F.sum("_leaf").alias("n_leaves")
    )
    ends = ends_digests(whole.select("_end.*", "conv_id"))

    # All first turns have the root above them, which needs no join.
    first = nodes.where("depth = 0").select(F.col("conv_id").alias("_root"))
    least = first.first()
    parents = nodes.select(*KEY, F.col("conv_id").alias("_above"))
    deep = nodes.where("depth > 1").select(F.struct("depth", "a", "b", "conv_id", "n_convs", "n_children").alias("_node"), *up)
    deep = deep.join(parents, KEY, "left").select("_node.*", F.col("_above").alias("parent_conv_id"))
    above = F.when(F.col("depth") == 1, F.lit(least["_root"] if least else None)).cast("long")
    shallow = nodes.where("depth <= 1").select(*KEY, "conv_id", "n_convs", "n_children", above.alias("parent_conv_id"))
    found = deep.unionByName(shallow).join(sums, KEY).join(ends, KEY, "left")
    return found.select(
        F.col("conv_id").cast("long").alias("conv_id"), "depth", F.col("parent_conv_id").cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "a", "b",
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of the decimal ids (KEY, conv_id) at each key, ascending and joined by commas.

    Ids are cut into ranges; a range hands on strings of PART_BYTES, which are hashed one after the other."""
    names, part_bytes = [*KEY, "first", "ids"], PART_BYTES

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, out = None, None, [], 0, []
        for batch in batches:
            for *at, conv in zip(*(column.to_pylist() for column in batch.columns)):
                if at != key or size > part_bytes:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, first, ids, size = at, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _batch(out, names)
            out = []
        if ids:
            yield _batch([(*key, first, ",".join(ids))], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *at, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if at == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256()
                state.update(ids.encode())
            yield _batch(out, [*KEY, "ends_sha256"])
            out = []
        if state:
            yield _batch([(*key, state.hexdigest())], [*KEY, "ends_sha256"])

    parts = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = parts.mapInArrow(tidy(join), "depth long, a long, b long, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(tidy(digest), "depth long, a long, b long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string() if name in ("ids", "ends_sha256") else pa.int64() for name in names]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
